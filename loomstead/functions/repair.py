"""Columns that bring what models answered into a sound form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of relation.
RELATIONS = (
    "governs",
    "depends_on",
    "is_part_of",
    "is_a",
    "manages",
    "uses",
    "defines",
    "implements",
    "complies_with",
    "references",
    "supports",
    "includes",
    "constrains",
    "enforces",
    "enables",
)
#: Other words for them.
SYNONYMS = {
    "governed_by": "governs",
    "is_governed_by": "governs",
    "governs_usage_of": "governs",
    "governs_stages_of": "governs",
    "governs_safety_of": "governs",
    "governs_process_of": "governs",
    "governs_new_instances_of": "governs",
    "governs_conditions_of": "governs",
    "oversees": "governs",
    "regulated_by": "governs",
    "is_regulated_by": "governs",
    "enforced_by": "enforces",
    "is_enforced_by": "enforces",
    "enforces_training_for": "enforces",
    "enforces_protection_of": "enforces",
    "must_comply_with": "complies_with",
    "must_adhere_to": "complies_with",
    "upheld_by": "complies_with",
    "sub_process_of": "is_part_of",
    "is_subset_of": "is_part_of",
    "is_a_subset_of": "is_part_of",
    "is_subject_to": "is_part_of",
    "specializes": "is_a",
    "extends": "is_a",
    "includes_variant": "includes",
    "includes_references_to": "includes",
    "populates": "includes",
    "integrates_with": "includes",
    "requires": "depends_on",
    "requires_approval_by": "depends_on",
    "requires_assignment_of": "depends_on",
    "requires_documentation": "depends_on",
    "requires_documentation_from": "depends_on",
    "requires_format": "depends_on",
    "depends_on_approval_from": "depends_on",
    "is_required_by": "depends_on",
    "is_mandatory_in": "depends_on",
    "must_use": "uses",
    "utilizes": "uses",
    "uses_data_from": "uses",
    "uses_for_monitoring": "uses",
    "operates_and_secures": "manages",
    "owns_and_manages": "manages",
    "manages_operations_of": "manages",
    "managed_by": "manages",
    "coordinates": "manages",
    "coordinates_with": "manages",
    "responsible_for": "manages",
    "creates_and_maintains": "manages",
    "initiates": "manages",
    "executes": "implements",
    "applies_to": "implements",
    "implements_for": "implements",
    "defines_rules_for": "defines",
    "defines_principles_for": "defines",
    "defines_requirements_for": "defines",
    "defines_structure_of": "defines",
    "defines_parameters_for": "defines",
    "defines_accountability_for": "defines",
    "defines_legal_status_of": "defines",
    "defines_approval_framework_for": "defines",
    "defines_risk_level_of": "defines",
    "defines_level_S": "defines",
    "defined_in": "defines",
    "is_the_basis_for": "defines",
    "classifies": "defines",
    "augments": "supports",
    "complements": "supports",
    "funds": "supports",
    "enables_resource_acquisition_for": "enables",
    "enables_usage_of": "enables",
    "is_tracked_via": "enables",
    "secures": "constrains",
    "threatens": "constrains",
    "limits_hardware_for": "constrains",
    "restricts_scope_of": "constrains",
    "determines_thresholds_for": "constrains",
    "references_topic": "references",
    "follows_rules_of": "references",
    "follows_process_of": "references",
    "methodologically_directs": "references",
    "transfers_deliverables_to": "references",
    "hands_over_to": "references",
    "precedes": "references",
    "triggers": "references",
    "must_be_recorded_in": "references",
    "is_applied_at_level_D": "references",
    "provides_standards_for": "defines",
    "provides_deviation_pathway_for": "enables",
    "verifies": "complies_with",
    "verifies_compliance_with": "complies_with",
    "validates": "complies_with",
    "authorizes": "enables",
    "approves": "enables",
}


def ranking(values: Column, n: Column) -> Column:
    """A full permutation of 0 to n - 1: whole numbers in range first, each once, then the rest in order."""
    whole = F.transform(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)), lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int"))
    good = F.array_distinct(F.filter(whole, lambda x: (x >= 0) & (x < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_union(good, every)


def verdict(status: Column, index: Column) -> Column:
    """(status, supersedes): unknown statuses are `consistent`; an index stays only on an update, if whole and not negative."""
    known = F.when(status.isin("consistent", "conflict", "update", "duplicate"), status).otherwise("consistent")
    at = F.expr("NULL").cast("int") if index is None else index.try_cast("double")
    good = (known == "update") & (at >= 0) & (at == F.floor(at))
    return F.struct(known.alias("status"), F.when(good, at.cast("int")).alias("supersedes"))


def keywords(values: Column, most: int = 8) -> Column:
    """Trimmed words of two letters or more, at most 8; null if none is left."""
    good = F.slice(F.filter(F.transform(values, lambda w: F.trim(w)), lambda w: F.length(w) > 1), 1, most)
    return F.when(F.size(good) > 0, good)


def keyword_probe(question: Column, words: Column) -> Column:
    """The keywords joined, unless each is in the question already."""
    new = F.exists(words, lambda w: ~F.contains(F.lower(question), F.lower(w)))
    return F.when(F.coalesce(new, F.lit(False)), F.array_join(words, " "))


def distinct_by_label(values: Column, name: str) -> Column:
    """Array of structs: the first of each non-empty label."""
    empty = F.filter(values, lambda x: F.coalesce(F.trim(x[name]), F.lit("")) != "")
    labels = F.transform(empty, lambda x: x[name])
    return F.filter(empty, lambda x, i: F.array_position(labels, x[name]) == i + 1)


def relation(value: Column) -> Column:
    """One of the known relations, or that which the word stands for; else null. Spaces count as underscores."""
    key = F.regexp_replace(F.trim(F.lower(value)), r"\s+", "_")
    same = F.element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), key)
    return F.when(key.isin(*RELATIONS), key).otherwise(same)


def json_or(text: Column, schema: str, fallback: Column) -> Column:
    return F.coalesce(F.from_json(text, schema), fallback)


def tags(values: Column, group: str = "group", name: str = "name") -> Column:
    """group: name, joined by commas; the name alone where there is no group."""
    return F.array_join(F.transform(values, lambda t: F.concat_ws(": ", t[group], t[name])), ", ")


def assessment(identified: Column, verdict_: Column, confidence: Column, strengths: Column, concerns: Column) -> Column:
    """Unidentified collapses; enums fall back, confidence is clamped to 0..1, lists are trimmed and capped at 6."""
    verdicts = ("best_in_class", "solid", "adequate", "questionable", "replace")
    cap = lambda x: F.slice(F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: s != ""), 1, 6)
    none = F.array().cast("array<string>")
    yes = F.coalesce(identified, F.lit(False))
    return F.struct(
        yes.alias("identified"),
        F.when(yes & verdict_.isin(*verdicts), verdict_).otherwise("unknown").alias("verdict"),
        F.when(yes, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))).otherwise(0.0).alias("confidence"),
        F.when(yes, F.coalesce(cap(strengths), none)).otherwise(none).alias("strengths"),
        F.when(yes, F.coalesce(cap(concerns), none)).otherwise(none).alias("concerns"),
    )
