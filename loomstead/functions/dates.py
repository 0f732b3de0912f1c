"""Coarse dates, lifecycles, buckets of local time, exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from worst to least, and their weights.
SEVERITIES = ("critical", "high", "medium", "low")
WEIGHTS = {"critical": 1000, "high": 300, "medium": 60, "low": 10}
CRITICALITY = {"missionCritical": 30, "businessCritical": 20, "businessOperational": 10}


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def coarse_date(text: Column) -> Column:
    """The text if it is a year, a month or a day that exists; else null."""
    t = F.trim(text)
    day = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), t)


def widened(text: Column) -> Column:
    """The last day that a coarse date can mean."""
    t = coarse_date(text)
    month = F.last_day(F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd"))
    return F.when(F.length(t) == 4, F.make_date(t.cast("int"), F.lit(12), F.lit(31))).when(F.length(t) == 7, month).otherwise(F.try_to_date(t, "yyyy-MM-dd"))


def cutoff(now: Column, months: int) -> Column:
    """So many whole months before, at the end of the month where the day doesn't exist."""
    return F.add_months(now, -months)


def is_current(text: Column, now: Column, months: int) -> Column:
    """A coarse date whose last day is no earlier than the cutoff; undated is never current."""
    return F.coalesce(widened(text) >= cutoff(now, months), F.lit(False))


def months_away(end: Column, now: Column) -> Column:
    return F.date_diff(end, now) / F.lit(30.44)


def exposure(severity: Column, reach: Column) -> Column:
    """weight x (1 + log10(1 + reach)); a bad reach counts as 0, an unknown severity as 1."""
    return F.coalesce(lookup(WEIGHTS, severity), F.lit(1)) * (1 + F.log10(1 + F.greatest(F.coalesce(reach, F.lit(0)), F.lit(0))))


def severity_rank(severity: Column) -> Column:
    """0 for the worst, unknown ones and null last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(len(SEVERITIES)).cast("int")


def research_priority(reach: Column, criticality: Column) -> Column:
    return F.coalesce(reach, F.lit(0)) + F.coalesce(lookup(CRITICALITY, criticality), F.lit(0))


def bucket_start(ts: Column, hours: int, offset_minutes: int) -> Column:
    """UTC start of the bucket of 1, 6 or 24 local hours; the zone is given in minutes, held within 14 hours."""
    shift = max(-840, min(840, offset_minutes)) * 60
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor((seconds + shift) / (hours * 3600)) * (hours * 3600) - shift)
