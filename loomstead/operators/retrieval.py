"""From hits to a context: expansion by one hop, slots for claims, text for each query. Tables of queries in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.repair import ranking
from loomstead.functions.text import fold, tokens
from loomstead.storage import kept, sized_join

#: Scores of topics that no vector found: by keyword, and by the report of a community.
KEYWORD_SCORE, THEMATIC_SCORE = 0.4, 0.35
#: Code points of a keyword at least, and of the pieces by which keywords and texts meet.
KEYWORD_LENGTH = 4


def pooled(lists: list[DataFrame], rankings: DataFrame | None, most: int) -> DataFrame:
    """(qid, id, score, place): the hits (qid, id, score) of several probes as one list, each id with its best score. A query with more than
    `most` of them is reordered by its ranking (qid, ranking: places from 0, as a model gave them, repaired to a full permutation), if
    it has one; the first `most` stay. Without a ranking the order is by score, then id."""
    every = lists[0].select("qid", "id", "score")
    for other in lists[1:]:
        every = every.unionByName(other.select("qid", "id", "score"))
    pool = every.groupBy("qid", "id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    pool = pool.withColumns({"at_": F.row_number().over(by_score) - 1, "n_": F.count("*").over(Window.partitionBy("qid"))})
    if rankings is None:
        place = F.col("at_") + 1
    else:
        pool = pool.join(rankings.select(F.col("qid").alias("q_"), "ranking").hint("merge"), F.col("qid") == F.col("q_"), "left")
        moved = F.array_position(ranking(F.col("ranking"), F.col("n_").cast("int")), F.col("at_").cast("int"))
        place = F.when((F.col("n_") > most) & F.col("ranking").isNotNull(), moved).otherwise(F.col("at_") + 1)
    return pool.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("qid", "id", "score", "place")


def keyword_topics(asked: DataFrame, topics: DataFrame, most: int) -> DataFrame:
    """(qid, id, score): topics whose key or folded description contains a word of the query or one of its keywords, of more than
    three code points, whatever the case; the first `most` ids of a query. asked: qid, query, keywords (array); topics: id, key, description.

    A word within a text is found by a join: words and texts meet by pieces of four letters, each word by the piece of its own that
    the fewest topics have, and what meets is compared whole. A word that every topic has still meets every topic; one of the
    query's others does not."""
    folded = lambda c: F.lower(fold(c))
    words = F.concat(tokens(folded(F.coalesce("query", F.lit("")))), F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: F.lower(w)))
    each = asked.select("qid", F.explode(F.array_distinct(words)).alias("word")).select("qid", folded(F.col("word")).alias("word"))
    each = kept(each.filter(F.length("word") >= KEYWORD_LENGTH).distinct(), "keyword-words")
    pieces = lambda c: F.when(F.length(c) >= KEYWORD_LENGTH, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - KEYWORD_LENGTH + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(KEYWORD_LENGTH)))).otherwise(F.array().cast("array<string>"))
    texts = kept(topics.select("id", F.lower(F.coalesce("key", F.lit(""))).alias("key"), folded(F.coalesce("description", F.lit(""))).alias("text")), "keyword-topics")
    of_word = kept(each.select("word").distinct().select("word", F.explode(F.array_distinct(pieces(F.col("word")))).alias("piece")), "keyword-pieces")
    of_text = texts.select("id", F.explode(F.array_distinct(F.concat(pieces(F.col("key")), pieces(F.col("text"))))).alias("piece"))
    of_text = kept(of_text.join(of_word.select("piece").distinct().hint("merge"), "piece", "left_semi"), "keyword-met")
    often = of_text.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = of_word.join(often.hint("merge"), "piece", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    met = rarest.filter("r.n > 0").select("word", F.col("r.piece").alias("piece")).join(of_text.hint("merge"), "piece").select("word", "id")
    sure = met.join(texts.hint("merge"), "id").filter(F.contains("key", F.col("word")) | F.contains("text", F.col("word"))).select("word", "id")
    hits = sure.join(each.hint("merge"), "word").select("qid", "id").distinct()
    w = Window.partitionBy("qid").orderBy("id")
    return hits.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= most).select("qid", "id", F.lit(KEYWORD_SCORE).alias("score"))


def thematic_topics(unanswered: DataFrame, reports: DataFrame, members: DataFrame, least: float, top: int, most: int) -> DataFrame:
    """(qid, id, score): for queries (qid) that nothing else answered, the members of the communities whose reports are near enough,
    the nearest `top` of them, each with its `most` members of the most claims, then by name. reports: qid, community, score;
    members: community, id, name, claims. Members are cut to `most` before they meet the queries."""
    near = reports.filter((F.col("score") >= least) & F.col("community").isNotNull()).join(unanswered.select("qid").distinct().hint("merge"), "qid", "left_semi")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "community")
    near = near.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= top).select("qid", "community")
    best = Window.partitionBy("community").orderBy(F.desc("claims"), "name", "id")
    first = members.withColumn("n_", F.row_number().over(best)).filter(F.col("n_") <= most).select("community", "id")
    return near.join(first.hint("merge"), "community").select("qid", "id").distinct().withColumn("score", F.lit(THEMATIC_SCORE))


def recall_report(exact: DataFrame, near: DataFrame, place: DataFrame, level: Column) -> DataFrame:
    """(level, n_queries, recall_10, recall_20, top_1_kept, mean_rank, band) of the first 20 of an exact search (qid, id, rank) against an
    approximate one's (qid, id, near), and the place that the approximate one gives the exact best (qid, place). Bands: 0.95, 0.90."""
    both = exact.select("qid", "id", "rank").join(near.hint("merge"), ["qid", "id"], "left")
    hit = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("near") <= k), 1).otherwise(0)) / F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    of = both.groupBy("qid").agg(hit(10).alias("r10"), hit(20).alias("r20"), F.max(F.when((F.col("rank") == 1) & (F.col("near") == 1), 1).otherwise(0)).alias("first"))
    of = of.join(place.hint("merge"), "qid").withColumn("level", level)
    out = of.groupBy("level").agg(F.count("*").alias("n_queries"), F.round(F.avg("r10"), 6).alias("recall_10"), F.round(F.avg("r20"), 6).alias("recall_20"), F.round(F.avg("first"), 6).alias("top_1_kept"), F.round(F.avg("place"), 6).alias("mean_rank"))
    return out.withColumn("band", F.when(F.col("recall_20") >= 0.95, "OK").when(F.col("recall_20") >= 0.9, "MARGINAL").otherwise("LOSSY"))


#: Pairs of a query and a member that a task of `community_hits` makes, about.
PAIRS_A_TASK = 1 << 21


def community_hits(reports: DataFrame, members: DataFrame, least: float, top: int) -> DataFrame:
    """(qid, id, score): members of the communities whose reports are near enough, the nearest `top` a query, all at the floor.

    A large community is dealt into parts of its members, each of which all of its queries meet. A member of several of a query's
    communities is found in the least of them alone, so that the pairs, which grow with the square, are neither shuffled nor held."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "community")
    near = reports.filter(F.col("score") >= least).withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= top)
    near = kept(near.filter("community IS NOT NULL").groupBy("qid").agg(F.collect_set("community").alias("near_")), "community-near")
    of = members.filter("community IS NOT NULL").groupBy("id").agg(F.collect_set("community").alias("in_"))
    of = kept(of.select("id", "in_", F.explode("in_").alias("c_")), "community-members")
    asked = near.select("qid", "near_", F.explode("near_").alias("c_"))
    sizes = asked.groupBy("c_").agg(F.count("*").alias("q_")).join(of.groupBy("c_").agg(F.count("*").alias("m_")).hint("merge"), "c_")
    parts = F.least(F.ceil(F.col("q_") * F.col("m_") / PAIRS_A_TASK), F.col("m_")).cast("int")
    sizes = kept(sizes.select("c_", parts.alias("parts_")), "community-parts")
    n = sizes.agg(F.coalesce(F.sum("parts_"), F.lit(0)).cast("long")).first()[0]
    of = sized_join(of, sizes, "c_", "inner").withColumn("part_", F.pmod(F.xxhash64("id"), F.col("parts_")).cast("int")).drop("parts_")
    asked = sized_join(asked, sizes, "c_", "inner").withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    deal = lambda df: df.repartition(max(1, min(n, 100_000)), "c_", "part_")
    found = deal(asked).join(deal(of).hint("shuffle_hash"), ["c_", "part_"])
    return found.filter(F.col("c_") == F.array_min(F.array_intersect("near_", "in_"))).select("qid", "id", F.lit(least).alias("score"))


def expand(hits: DataFrame, edges: DataFrame, score: float = 0.5, factor: int = 2) -> DataFrame:
    """hits (qid, id, score) with their neighbours, strongest edges first, so that a query has at most `factor` times its
    topics. edges: a, b, weight, both ways."""
    new = hits.join(edges, F.col("id") == F.col("a")).groupBy("qid", F.col("b").alias("id")).agg(F.max("weight").alias("weight"))
    new = new.join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    have = hits.groupBy("qid").agg(F.count("*").alias("have"))
    w = Window.partitionBy("qid").orderBy(F.desc("weight"), "id")
    room = F.col("have") * (factor - 1)
    more = new.join(have, "qid").withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= room)
    return hits.select("qid", "id", "score").unionByName(more.select("qid", "id", F.lit(score).alias("score")))


def claim_slots(conflicts: DataFrame, semantic: DataFrame, topical: DataFrame, most: int, question: Column, boosted: list[str]) -> DataFrame:
    """(qid, claim_id, claim_type, score, place): all conflicts (0.2), then semantic hits, then topic claims (0.3) up to the cap.
    A claim counts once, by its first list; some types score half as much again for questions."""
    part = lambda df, rank, s: df.select("qid", "claim_id", "claim_type", F.lit(rank).alias("rank"), s.cast("double").alias("score"))
    every = part(conflicts, 0, F.lit(0.2)).unionByName(part(semantic, 1, F.col("score"))).unionByName(part(topical, 2, F.lit(0.3)))
    once = every.groupBy("qid", "claim_id", "claim_type").agg(F.min(F.struct("rank", (-F.col("score")).alias("far"))).alias("m"))
    w = Window.partitionBy("qid").orderBy("m.rank", "m.far", "claim_id")
    kept = once.withColumn("place", F.row_number().over(w).cast("long")).filter((F.col("place") <= most) | (F.col("m.rank") == 0))
    boost = F.when(question & F.col("claim_type").isin(*boosted), 1.5).otherwise(1.0)
    return kept.select("qid", "claim_id", "claim_type", F.round(-F.col("m.far") * boost, 6).alias("score"), "place")


def contexts(rows: DataFrame) -> DataFrame:
    """(qid, n_topics, n_claims, disputed, context): rows (qid, topic, score, status, claim_text) as text, topics by score."""
    lines = F.array_join(F.sort_array(F.collect_set(F.concat(F.when(F.col("status") == "conflicted", "[disputed] ").otherwise("- "), F.col("claim_text")))), "\n")
    topics = rows.groupBy("qid", "topic").agg(F.max("score").alias("score"), F.count_distinct("claim_text").alias("n"), F.bool_or(F.col("status") == "conflicted").alias("d"), lines.alias("lines"))
    part = F.struct((-F.col("score")).alias("far"), "topic", F.concat(F.lit("## "), F.col("topic"), F.lit("\n"), F.col("lines")).alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "\n\n")
    return topics.groupBy("qid").agg(F.count("*").alias("n_topics"), F.sum("n").alias("n_claims"), F.bool_or("d").alias("disputed"), text.alias("context"))
