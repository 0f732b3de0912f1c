"""The store of topics, relations and claims: merging, exact and near duplicates, verdicts, shared support, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import topic_key, words_key
from loomstead.operators.relational import numbered
from loomstead.storage import dealt


def merge_topics(rows: DataFrame) -> DataFrame:
    """One topic for each key: the longest description (ties: smallest id), the first category, the first name."""
    r = rows.withColumn("key", topic_key(F.col("name")))
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("id")))
    category = F.min_by("category", F.when(F.col("category").isNotNull(), F.col("id")))
    return r.groupBy("key").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), longest.alias("description"), category.alias("category"))


def resolve_names(asked: DataFrame, topics: DataFrame) -> DataFrame:
    """asked (name) with topic_id: by the name itself, then by key; what isn't found is dropped."""
    by_name = topics.groupBy("name").agg(F.min("id").alias("a_"))
    by_key = topics.groupBy(topic_key(F.col("name")).alias("k_")).agg(F.min("id").alias("b_"))
    found = asked.join(by_name, "name", "left").withColumn("q_", topic_key(F.col("name"))).join(by_key, F.col("q_") == F.col("k_"), "left")
    return found.withColumn("topic_id", F.coalesce("a_", "b_")).filter("topic_id IS NOT NULL").drop("a_", "b_", "k_", "q_")


def insert_claims(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, support): the first row of each text, and every (claim, document) that asserts it."""
    r = rows.withColumn("claim_hash", F.sha2("claim_text", 256))
    claims = r.groupBy("claim_hash").agg(F.min("id").alias("claim_id"), F.min_by(F.struct("topic_id", "doc_id", "claim_text", "status"), "id").alias("c")).select("claim_hash", "claim_id", "c.*")
    support = r.groupBy("claim_hash", "doc_id").agg(F.min("id").alias("first_id")).join(claims.select("claim_hash", "claim_id"), "claim_hash").select("claim_id", "doc_id", "first_id")
    return claims, support


def drop_near_duplicates(rows: DataFrame, batch: list[str], text: str, by: str) -> DataFrame:
    """The first row of each batch and normalised text."""
    w = Window.partitionBy(*batch, words_key(F.col(text))).orderBy(by)
    return rows.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def apply_verdicts(new: DataFrame, verdicts: DataFrame, rows: int | None = None) -> DataFrame:
    """new claims (id) with their status: duplicates skipped, misaligned flagged, conflicts marked; an update retires a claim once.
    Verdicts that supersede nothing are dealt by their own ids, as they would all be one group. rows: about how many claims there are, if
    that is known; tasks are then as many as these need."""
    spread = (lambda df, *keys: df) if rows is None else (lambda df, *keys: dealt(df, rows, *keys))
    v = verdicts.withColumn("lone_", F.when(F.col("supersedes").isNull(), F.col("id")))
    w = Window.partitionBy("supersedes", "lone_").orderBy("id")
    v = spread(v, "supersedes", "lone_").withColumn("first_", F.row_number().over(w) == 1)
    status = F.when(F.col("verdict") == "duplicate", "skipped").when(~F.coalesce("aligned", F.lit(True)), "flagged").when(F.col("verdict") == "conflict", "conflicted").otherwise("active")
    retires = F.when((F.col("verdict") == "update") & F.col("first_") & F.coalesce("aligned", F.lit(True)), F.col("supersedes"))
    both = spread(new, "id").join(spread(v, "id"), "id", "left")
    return both.withColumns({"status": status, "retires": retires}).drop("first_", "lone_", "verdict", "supersedes", "aligned")


def reattribute(claims: DataFrame, support: DataFrame, removed: DataFrame) -> DataFrame:
    """claims after some documents go: those with other support move to the lowest surviving document, sole ones go."""
    gone = removed.select("doc_id").distinct()
    left = support.join(gone, "doc_id", "left_anti").groupBy("claim_id").agg(F.min("doc_id").alias("heir_"))
    marked = claims.join(gone.withColumn("gone_", F.lit(True)), "doc_id", "left").join(left, "claim_id", "left")
    kept = marked.filter(F.col("gone_").isNull() | F.col("heir_").isNotNull())
    return kept.withColumn("doc_id", F.when(F.col("gone_").isNull(), F.col("doc_id")).otherwise(F.col("heir_"))).drop("gone_", "heir_")


def orphans(topics: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    return topics.join(claims.select(F.col("topic_id").alias("id")), "id", "left_anti").join(links, "id", "left_anti")


def review(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """claims with the outcome of each decision: accept and dismiss activate, reject deletes, restore only what is superseded."""
    d = F.col("decision")
    outcome = F.when(d.isin("accept", "dismiss"), "active").when(d == "reject", "deleted").when((d == "restore") & (F.col("status") == "superseded"), "active").otherwise("invalid")
    return claims.join(decisions, "id").withColumn("outcome", outcome)


def reconcile_alerts(stored: DataFrame, new: DataFrame, refreshed: DataFrame) -> DataFrame:
    """(asset_id, fingerprint, first_seen, last_seen): seen again moves the end, first seen stays; what a refreshed asset no
    longer shows goes."""
    keys = ["asset_id", "fingerprint"]
    n = new.groupBy(*keys).agg(F.min("seen_at").alias("n1"), F.max("seen_at").alias("n2"))
    both = stored.join(n, keys, "full_outer").join(refreshed.select("asset_id").distinct().withColumn("r_", F.lit(True)), "asset_id", "left")
    kept = both.filter(F.col("n1").isNotNull() | F.col("r_").isNull())
    return kept.select(*keys, F.least("first_seen", "n1").alias("first_seen"), F.greatest("last_seen", "n2").alias("last_seen"))


def refresh_due(rows: DataFrame, most: int) -> DataFrame:
    """Why each candidate is due (new, changed, errored, stale, forced), in order; `deferred` beyond the first `most`."""
    reasons = ["new", "changed", "errored", "stale", "forced"]
    why = F.when(F.col("researched_days").isNull(), "new").when(F.col("hash_changed"), "changed").when(F.col("had_error"), "errored").when(F.col("researched_days") > F.when(F.col("identified"), 90).otherwise(30), "stale").when(F.col("forced"), "forced")
    due = rows.withColumn("reason", why).filter("reason IS NOT NULL")
    order = [F.array_position(F.array(*[F.lit(x) for x in reasons]), F.col("reason")), F.desc("priority"), F.desc_nulls_first("researched_days"), F.col("id")]
    return numbered(due, order, "place").withColumn("deferred", F.col("place") > most)


def aligned(topic: Column, claim: Column, cosine: Column, least: float = 0.35) -> Column:
    """Whether a claim is about its topic: a longer topic word occurs in it, the topic has under two such words, or their
    vectors are near; without vectors it is not."""
    long_ = F.filter(F.split(F.lower(topic), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    return (F.size(long_) < 2) | F.exists(long_, lambda w: F.contains(F.lower(claim), w)) | F.coalesce(cosine >= least, F.lit(False))
