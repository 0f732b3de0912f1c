"""Communities and their reports: members, noise, which reports a refresh reuses, writes, puts off and removes, and what a report is
written from. Communities may hold any share of all topics: their members are rows, and never gathered into one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.storage import kept, sized_join

#: Topics of a community at least for a report; reports that a refresh writes at most; claims and relations that a report is written from.
LEAST_MEMBERS, MOST_REPORTS = 3, 25
MOST_CLAIMS, MOST_RELATIONS = 40, 30


def is_noise(community: Column) -> Column:
    return community.isNull() | (community == -1)


def noise(topics: DataFrame) -> DataFrame:
    """(id, name) of topics in no community."""
    return topics.filter(is_noise(F.col("community"))).select("id", "name")


def fellows(topics: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, community, id, name): the other members of the community of each topic asked for; noise has none."""
    of = topics.join(asked.select(F.col("id").alias("asked")).distinct().hint("merge"), F.col("id") == F.col("asked"))
    of = of.filter(~is_noise(F.col("community"))).select("asked", F.col("community").alias("c_"))
    found = topics.select("id", "name", "community").join(of.hint("merge"), F.col("community") == F.col("c_"))
    return found.filter("id <> asked").select("asked", "community", "id", "name")


def members(topics: DataFrame, active_claims: DataFrame) -> DataFrame:
    """(community, id, name, claims) of all topics in communities. active_claims: topic_id, a row a claim."""
    n = active_claims.groupBy(F.col("topic_id").alias("t_")).agg(F.count("*").alias("n_"))
    rows = topics.filter(~is_noise(F.col("community"))).join(n.hint("merge"), F.col("id") == F.col("t_"), "left")
    return rows.select("community", "id", "name", F.coalesce("n_", F.lit(0)).alias("claims"))


def identities(of: DataFrame) -> DataFrame:
    """(community, size, claims, identity) of members (community, id, claims): the identity of a community by content, as ids of
    communities change from run to run. It is a hash of the number, two sums of 64-bit hashes of the ids, and the number of claims,
    so it needs no list of the members."""
    twice = [F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    size, claims = F.count("*"), F.coalesce(F.sum("claims"), F.lit(0))
    identity = F.sha2(F.concat_ws(":", size.cast("string"), *twice, claims.cast("string")), 256)
    return of.groupBy("community").agg(size.alias("size"), claims.cast("long").alias("claims"), identity.alias("identity"))


def refresh_plan(communities: DataFrame, stored: DataFrame, least: int = LEAST_MEMBERS, most: int = MOST_REPORTS) -> DataFrame:
    """(community, size, claims, identity, action) of identities(...), and of stored reports (identity) that no longer belong to any:
    `skipped` (too small), `reused` (a report of this identity is stored), `generate` (the largest `most` of the others), `deferred` (the
    rest, for a later refresh) and `pruned` (stored, of no community of now). Ties of size go by community."""
    now = kept(communities, "reports-now")
    have = stored.select(F.col("identity").alias("s_")).distinct()
    known = now.join(have.hint("merge"), F.col("identity") == F.col("s_"), "left")
    found = kept(known.withColumn("action", F.when(F.col("size") < least, "skipped").when(F.col("s_").isNotNull(), "reused")).drop("s_"), "reports-known")
    first = found.filter("action IS NULL").orderBy(F.desc("size"), "community").limit(most).select(F.col("community").alias("f_"))  # `most` rows
    plan = found.join(F.broadcast(first), F.col("community") == F.col("f_"), "left")
    plan = plan.withColumn("action", F.coalesce("action", F.when(F.col("f_").isNotNull(), "generate").otherwise("deferred"))).drop("f_")
    live = plan.filter("action IN ('reused', 'generate')").select("identity")
    gone = have.select(F.col("s_").alias("identity")).join(live.hint("merge"), "identity", "left_anti")
    empty = {c: F.lit(None).cast(now.schema[c].dataType) for c in ("community", "size", "claims")}
    return plan.unionByName(gone.withColumns(empty).withColumn("action", F.lit("pruned")).select(*plan.columns))


def refreshed(stored: DataFrame, plan: DataFrame, written: DataFrame) -> DataFrame:
    """The reports (identity, community, title, summary) after a refresh: reused ones under the community's number of now, written
    ones (identity, title, summary; those that a model failed to write are missing and come up again), and no pruned ones."""
    now = plan.select("identity", "community", "action")
    old = stored.drop("community").join(now.filter("action = 'reused'").hint("merge"), "identity")
    new = written.select("identity", "title", "summary").join(now.filter("action = 'generate'").hint("merge"), "identity")
    names = ["identity", "community", "title", "summary"]
    return old.select(*names).unionByName(new.select(*names))


def inputs(topics: DataFrame, active_claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, kind, place, text): what a report is written from, in rows. `topic`: every member's name (no place: by name);
    `claim`: 40 claims spread over the members, the first ceil(40 / members) of each by age, members in order of id; `relation`: up to 30
    relations inside the community, by ends and kind. active_claims: topic_id, id, claim_text, created_at; edges: source_id, target_id, rel."""
    of = topics.filter(~is_noise(F.col("community"))).select("community", "id", "name")
    size = of.groupBy("community").agg(F.count("*").alias("n_"))
    sized = sized_join(of, size.withColumnRenamed("community", "c_"), F.col("community") == F.col("c_"), "inner").drop("c_")
    by_age = Window.partitionBy("topic_id").orderBy("created_at", "claim_id")
    own = active_claims.select("topic_id", F.col("id").alias("claim_id"), "claim_text", "created_at")
    own = own.withColumn("r_", F.row_number().over(by_age)).filter(F.col("r_") <= MOST_CLAIMS)  # no member gives more
    spread = own.join(sized.hint("merge"), F.col("topic_id") == F.col("id")).filter(F.col("r_") <= F.ceil(MOST_CLAIMS / F.col("n_")))
    place = F.row_number().over(Window.partitionBy("community").orderBy("topic_id", "r_"))
    claims = spread.withColumn("place", place).filter(F.col("place") <= MOST_CLAIMS).select("community", F.lit("claim").alias("kind"), "place", F.col("claim_text").alias("text"))
    end = lambda side: of.select(F.col("id").alias(f"{side}_id"), F.col("community").alias(f"{side}_c"), F.col("name").alias(f"{side}_name")).hint("merge")
    inner = edges.join(end("source"), "source_id").join(end("target"), "target_id").filter("source_c = target_c")
    at = F.row_number().over(Window.partitionBy("source_c").orderBy("source_id", "target_id", "rel"))
    said = F.concat("source_name", F.lit(" \u2014"), "rel", F.lit("\u2192 "), "target_name")
    relations = inner.withColumn("place", at).filter(F.col("place") <= MOST_RELATIONS).select(F.col("source_c").alias("community"), F.lit("relation").alias("kind"), "place", said.alias("text"))
    named = of.select("community", F.lit("topic").alias("kind"), F.lit(None).cast("int").alias("place"), F.col("name").alias("text"))
    return named.unionByName(claims).unionByName(relations)
