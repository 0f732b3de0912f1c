"""Queries of streams (S) and of what SQL users can call (D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstead import streaming as s
from loomstead.plans.columns import NOW
from loomstead.plans.registry import query
from loomstead.sources.keyed import KeyedTable
from loomstead.storage import shared_dir


def events(t):
    path = f"{t.sf_dir}/events.parque[t]"  # a pattern, as the source takes no single file by name
    return s.read(t.spark, path, t.events.schema)


CATEGORY = {"view": "chat", "click": "documents", "signup": "knowledge", "purchase": "market"}


def usage(t):
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv]), F.col("event_type")), F.lit("unknown"))
    total = F.floor("value").cast("long") + F.floor(F.col("value") * 9).cast("long")
    return events(t).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), named.alias("category"), total.alias("total_tokens"), "user_id")


THROTTLE = """WITH RECURSIVE o AS (SELECT id, user_id, epoch(created_at) AS e, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS r FROM (SELECT event_id AS id, user_id, ts AS created_at FROM events)),
w AS (SELECT id, user_id, e, r, e AS opened, 1 AS used FROM o WHERE r = 1 UNION ALL SELECT o.id, o.user_id, o.e, o.r, CASE WHEN o.e >= w.opened + 86400 THEN o.e ELSE w.opened END, CASE WHEN o.e >= w.opened + 86400 THEN 1 ELSE w.used + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
SELECT id, user_id, used <= 2 AS allowed FROM w"""


@query("S01_throttle", THROTTLE)
def s01(t):
    rows = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
    return s.throttle(rows, "user_id", 2, 86400.0)


@query("S01_throttle_stream", THROTTLE)
def s01b(t):
    rows = events(t).select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
    return s.drained(s.throttle_stream(rows, "user_id", 2, 86400.0)).select("id", "user_id", "allowed")


@query("S02_tumbling_totals", """SELECT CAST(to_timestamp(floor(epoch(date_trunc('second', created_at)) / 21600) * 21600) AT TIME ZONE 'UTC' AS STRING) AS bucket, category,
      CAST(sum(total_tokens) AS BIGINT) AS total, count(*) AS calls
    FROM usage_log
    GROUP BY 1, 2
    HAVING floor(max(epoch(created_at)) / 21600) * 21600 + 21600 <= (SELECT max(epoch(created_at)) - 3600
    FROM usage_log)""")
def s02(t):
    return s.drained(s.usage_totals(usage(t), 6)).select("bucket", "category", "total", "calls")


@query("S03_bursts", """SELECT user_id, count(*) AS n_bursts
    FROM (SELECT user_id, burst, max(e) AS last_at
    FROM (SELECT user_id, e, sum(fresh) OVER (PARTITION BY user_id
    ORDER BY e, id) AS burst
    FROM (SELECT event_id AS id, user_id, ts AS e, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) >= INTERVAL 3 HOUR, true) THEN 1 ELSE 0 END AS fresh
    FROM events))
    GROUP BY 1, 2)
    WHERE last_at + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR
    FROM events)
    GROUP BY user_id""")
def s03(t):
    return s.drained(s.bursts(usage(t), "user_id", "3 hours")).groupBy("user_id").agg(F.count("*").alias("n_bursts"))


@query("S04_alert_state", """SELECT asset_id, title, CAST(min(seen_at) AS STRING) AS first_seen, CAST(max(seen_at) AS STRING) AS last_seen, count(*) AS n
    FROM alerts
    GROUP BY 1, 2""")
def s04(t):
    rows = events(t).select(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("asset_id"), F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string")).alias("title"), F.col("ts").alias("seen_at"))
    table = KeyedTable.create(t.spark, f"{shared_dir(t.spark)}/alerts-{uuid.uuid4().hex}", s.ALERTS, ["asset_id", "title"])
    return s.alert_state(rows, table).withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


STRIPPED = "length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''))"


@query("S05_ingest_unseen", f"SELECT sha256(text) AS h, {STRIPPED} > 100 AS has_chunks FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def s05(t):
    """Unseen contents, and whether the chunk sink holds any of theirs: all do whose text is longer than half an overlap."""
    arrived = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("doc_id", F.lit(3600))).alias("arrived_at")
    docs = s.read(t.spark, f"{t.sf_dir}/documents.parque[t]", t.documents.schema).filter("text IS NOT NULL").select("doc_id", "text", arrived)
    unseen, chunks = s.ingested(docs, "doc_id")
    found = chunks.select("doc_id").distinct().withColumn("has_chunks", F.lit(True))
    return unseen.join(found.hint("merge"), "doc_id", "left").select("h", F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"))


@query("S06_expiry", f"SELECT id FROM assets WHERE end_date IS NULL OR end_date >= {NOW}")
def s06(t):
    return s.expire(t.assets.select("id", "end_date"), "end_date", F.expr(NOW))[0].select("id")


@query("S06_expired", f"SELECT id FROM assets WHERE end_date < {NOW}")
def s06b(t):
    return s.expire(t.assets.select("id", "end_date"), "end_date", F.expr(NOW))[1].select("id")


@query("S06_expired_stream", f"SELECT CAST(substr(id, 2) AS BIGINT) AS p_partkey, CAST(end_date AS STRING) AS end_date FROM assets WHERE fs_type = 'Product' AND end_date < {NOW}")
def s06c(t):
    """Products as they were seen today, and which of them the passing of time has ended."""
    end = F.when((F.col("p_size") % 6).isin(3, 4), F.date_add(F.lit("2023-10-01").cast("date"), (F.col("p_partkey") * 37 % 900).cast("int")))
    rows = s.read(t.spark, f"{t.sf_dir}/part.parque[t]", t.part.schema).select("p_partkey", end.alias("end_date"), F.expr(NOW).cast("timestamp").alias("seen"))
    return s.drained(s.expired_stream(rows, "p_partkey", "end_date", "seen")).select("p_partkey", F.col("end_date").cast("date").cast("string").alias("end_date"))


@query("D01_fold_in_sql", """SELECT doc_id, replace(replace(replace(translate(strip_accents(text), 'øđðłħı', 'oddlhi'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS folded
    FROM documents""")
def d01(t):
    s.register(t.spark)
    return t.spark.sql("SELECT doc_id, fold(text) AS folded FROM {documents}", documents=t.documents)


@query("D03_chunks_in_sql")
def d03(t):
    s.register(t.spark)
    return t.spark.sql("SELECT d.doc_id, c.chunk_no, length(c.content) AS n_chars FROM {documents} d, LATERAL chunks(d.text) c", documents=t.documents)
