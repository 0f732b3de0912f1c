"""Queries of joins (J), aggregations (A), windows (W), paging (L) and sets (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstead.functions import dates
from loomstead.operators import relational as r
from loomstead.plans.columns import NOW, WIDE
from loomstead.plans.registry import query

VALID = "CASE WHEN try_cast(CASE length(event_date) WHEN 4 THEN event_date || '-01-01' WHEN 7 THEN event_date || '-01' ELSE event_date END AS DATE) IS NOT NULL THEN event_date END"


@query("C01_projection", "SELECT vec_id, label FROM embeddings")
def c01(t):
    return t.embeddings.select("vec_id", "label")


@query("J01_claims_of_topics", """SELECT c.id, t.name, coalesce(s_name, 'unknown') AS document
    FROM claims c
    JOIN topics t ON t.id = c.topic_id
    LEFT
    JOIN supplier s ON s_suppkey = c.doc_id
    WHERE c.status = 'active'""")
def j01(t):
    c = t.claims.filter("status = 'active'").select("id", "topic_id", "doc_id")
    named = t.topics.select(F.col("id").alias("topic_id"), "name")
    docs = t.supplier.select(F.col("s_suppkey").alias("doc_id"), "s_name")
    return c.join(named, "topic_id").join(docs, "doc_id", "left").select("id", "name", F.coalesce("s_name", F.lit("unknown")).alias("document"))


@query("J02_successors", """SELECT a.id, a.claim_text, b.id AS successor_id, b.claim_text AS successor_text
    FROM claims a
    LEFT
    JOIN claims b ON b.id = a.superseded_by
    WHERE a.status = 'superseded'""")
def j02(t):
    after = t.claims.select(F.col("id").alias("successor_id"), F.col("claim_text").alias("successor_text"))
    old = t.claims.filter("status = 'superseded'").select("id", "claim_text", "superseded_by")
    return old.join(after, old.superseded_by == after.successor_id, "left").drop("superseded_by")


@query("J03_chats_with_term", """SELECT conv_id, user_id, pinned
    FROM chats
    WHERE contains(lower(title), 'the ') OR conv_id IN (SELECT conv_id
    FROM conversations
    WHERE contains(lower(text), 'hand'))""")
def j03(t):
    said = t.conversations.filter(F.contains(F.lower("text"), F.lit("hand"))).select("conv_id")
    titled = t.chats.filter(F.contains(F.lower("title"), F.lit("the "))).select("conv_id")
    return t.chats.join(said.unionByName(titled), "conv_id", "left_semi").select("conv_id", "user_id", "pinned")


@query("J04_orphan_topics", """SELECT id, name
    FROM topics
    WHERE id NOT IN (SELECT topic_id
    FROM claims
    WHERE status = 'flagged') AND id + 1000000 NOT IN (SELECT target_id
    FROM topic_edges)""")
def j04(t):
    claimed = t.claims.filter("status = 'flagged'").select(F.col("topic_id").alias("id"))
    linked = t.topic_edges.select((F.col("target_id") - 1000000).alias("id"))
    return t.topics.join(claimed, "id", "left_anti").join(linked, "id", "left_anti").select("id", "name")


@query("J05_either_endpoint", """SELECT s_suppkey AS node, target_id AS other, rel, 'out' AS direction
    FROM supplier
    JOIN topic_edges ON source_id = s_suppkey
    UNION ALL SELECT 1000000 + p_partkey, source_id, rel, 'in'
    FROM part
    JOIN topic_edges ON target_id = 1000000 + p_partkey
    WHERE p_partkey % 2 = 0""")
def j05(t):
    wanted = t.supplier.select(F.col("s_suppkey").alias("node")).unionByName(t.part.filter("p_partkey % 2 = 0").select((F.col("p_partkey") + 1000000).alias("node")))
    return r.both_ways(t.topic_edges, "source_id", "target_id", "rel").join(wanted, "node").select("node", "other", "rel", "direction")


@query("J06_inner_edges", """SELECT source_id, target_id, rel
    FROM topic_edges
    WHERE source_id % 2 = 0 AND (target_id - 1000000) IN (SELECT p_partkey
    FROM part
    WHERE p_size > 10)""")
def j06(t):
    members = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node")).unionByName(t.part.filter("p_size > 10").select((F.col("p_partkey") + 1000000).alias("node")))
    return r.inside(t.topic_edges, members, "source_id", "target_id", "node").select("source_id", "target_id", "rel")


@query("J07_counts_in_one_pass", """SELECT id, (SELECT count(*)
    FROM relations
    WHERE from_id = a.id AND rel = 'serves') AS n_serves, (SELECT min(to_name)
    FROM relations
    WHERE from_id = a.id AND rel = 'vendor') AS vendor, (SELECT string_agg(to_name, ', '
    ORDER BY to_name)
    FROM relations
    WHERE from_id = a.id AND rel = 'org') AS orgs
    FROM assets a""")
def j07(t):
    is_ = lambda k: F.col("rel") == k
    names = F.sort_array(F.collect_list(F.when(is_("org"), F.col("to_name"))))
    c = t.relations.groupBy(F.col("from_id").alias("id")).agg(F.count(F.when(is_("serves"), 1)).alias("n_serves"), F.min(F.when(is_("vendor"), F.col("to_name"))).alias("vendor"), F.nullif(F.array_join(names, ", "), F.lit("")).alias("orgs"))
    return t.assets.select("id").join(c, "id", "left").select("id", F.coalesce("n_serves", F.lit(0)).alias("n_serves"), "vendor", "orgs")


@query("J08_far_ends", "SELECT r.to_id, coalesce(r.to_name, r.to_id) AS name, a.lifecycle FROM relations r LEFT JOIN assets a ON a.id = r.to_id WHERE r.from_id = 'S3'")
def j08(t):
    state = t.assets.select(F.col("id").alias("to_id"), "lifecycle")
    return t.relations.filter("from_id = 'S3'").join(state, "to_id", "left").select("to_id", F.coalesce("to_name", "to_id").alias("name"), "lifecycle")


@query("J09_two_key_lookup", """SELECT d.doc_id, coalesce(p.id, f.id) AS found
    FROM (SELECT doc_id, 'repo/' || source || '/' || CAST(doc_id + doc_id % 2 * 1000000 AS STRING) || '.md' AS path,
      CAST(doc_id AS STRING) || '.md' AS file
    FROM documents) d
    LEFT
    JOIN snapshot_old p ON p.path = d.path
    LEFT
    JOIN (SELECT regexp_extract(path, '[^/]+$') AS file, min(id) AS id
    FROM snapshot_old
    GROUP BY 1) f ON f.file = d.file""")
def j09(t):
    asked = t.documents.select("doc_id", F.concat(F.lit("repo/"), "source", F.lit("/"), (F.col("doc_id") + F.col("doc_id") % 2 * 1000000).cast("string"), F.lit(".md")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    by_path = t.snapshot_old.groupBy("path").agg(F.min("id").alias("by_path"))
    by_file = t.snapshot_old.groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("file")).agg(F.min("id").alias("by_file"))
    return asked.join(by_path, "path", "left").join(by_file, "file", "left").select("doc_id", F.coalesce("by_path", "by_file").alias("found"))


@query("J10_restricted_search", """SELECT doc_id, source
    FROM documents
    WHERE contains(lower(text), 'the') AND (source || '.md' IN (SELECT 'src' || CAST(n_nationkey AS STRING) || '.md'
    FROM nation
    WHERE n_nationkey < 6))""")
def j10(t):
    allowed = t.nation.filter("n_nationkey < 6").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("file"))
    hits = t.documents.filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", "source", F.concat("source", F.lit(".md")).alias("file"))
    return hits.join(allowed, "file", "left_semi").select("doc_id", "source")


@query("A01_degrees", "SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM topic_edges UNION ALL SELECT target_id FROM topic_edges) GROUP BY node")
def a01(t):
    return r.degrees(t.topic_edges, "source_id", "target_id")


@query("A02_claim_counts", "SELECT t.id, count(c.id) AS n_claims FROM topics t LEFT JOIN claims c ON c.topic_id = t.id AND c.status = 'active' GROUP BY t.id")
def a02(t):
    return r.counts_with_zero(t.topics.select("id"), t.claims.filter("status = 'active'").select(F.col("topic_id").alias("id")), "id", "n_claims")


@query("A03_status_counts", """SELECT coalesce(t.category, 'Uncategorized') AS category, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active,
      count(*) FILTER (WHERE status = 'conflicted') AS conflicted, count(*) FILTER (WHERE status = 'superseded') AS superseded
    FROM claims c
    JOIN topics t ON t.id = c.topic_id
    GROUP BY 1""")
def a03(t):
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    named = t.topics.select(F.col("id").alias("topic_id"), F.coalesce("category", F.lit("Uncategorized")).alias("category"))
    return t.claims.join(named, "topic_id").groupBy("category").agg(F.count("*").alias("n"), of("active"), of("conflicted"), of("superseded"))


MEASURES = "CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total, count(*) AS calls, CAST(coalesce(sum(total_tokens) FILTER (WHERE estimated = 1), 0) AS BIGINT) AS estimated_tokens"


def measures():
    zero = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return [zero("prompt_tokens", "prompt"), zero("completion_tokens", "completion"), zero("total_tokens", "total"), F.count("*").alias("calls"), zero(F.when(F.col("estimated") == 1, F.col("total_tokens")), "estimated_tokens")]


@query("A04_usage_measures", f"SELECT category, {MEASURES} FROM usage_log GROUP BY category")
def a04(t):
    return t.usage_log.groupBy("category").agg(*measures())


@query("A05_usage_levels", f"""SELECT CAST(grouping(category, operation, provider, model, kind) AS BIGINT) AS level, category, operation, provider, model, kind, {MEASURES}
    FROM usage_log
    GROUP BY GROUPING SETS ((), (category), (operation, category), (provider, model, kind))""")
def a05(t):
    keys = ["category", "operation", "provider", "model", "kind"]
    sets = [[], ["category"], ["operation", "category"], ["provider", "model", "kind"]]
    return t.usage_log.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(F.grouping_id(*keys).alias("level"), *measures())


@query("A06_usage_bounds", """SELECT CAST(min(created_at) AS STRING) AS first_at, CAST(max(created_at) AS STRING) AS last_at, CAST(sum(failed) AS BIGINT) AS failed
    FROM usage_log""")
def a06(t):
    return t.usage_log.agg(F.min("created_at").cast("string").alias("first_at"), F.max("created_at").cast("string").alias("last_at"), F.sum("failed").cast("long").alias("failed"))


@query("A07_duplicate_keys", "SELECT name, min(id) AS kept, count(*) AS n FROM topics GROUP BY name HAVING count(*) > 1")
def a07(t):
    return t.topics.groupBy("name").agg(F.min("id").alias("kept"), F.count("*").alias("n")).filter("n > 1")


@query("A08_hierarchy_distinct", """SELECT r_name, n_name, c_mktsegment, count(DISTINCT c_custkey % 500) AS members
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def a08(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count_distinct(F.col("c_custkey") % 500).alias("members"))


@query("A09_members", "SELECT category, count(*) AS n, string_agg(CAST(id AS STRING), ',' ORDER BY name, id) AS members FROM topics GROUP BY category")
def a09(t):
    m = F.transform(F.sort_array(F.collect_list(F.struct("name", "id"))), lambda x: x["id"].cast("string"))
    return t.topics.groupBy("category").agg(F.count("*").alias("n"), F.array_join(m, ",").alias("members"))


@query("A10_most_used", """SELECT t.id, t.name, count(e.target_id) AS n
    FROM topics t
    LEFT
    JOIN topic_edges e ON e.target_id = 1000000 + t.id
    GROUP BY t.id, t.name
    ORDER BY n DESC, t.id LIMIT 25""")
def a10(t):
    links = t.topic_edges.select((F.col("target_id") - 1000000).alias("id"))
    return r.counts_with_zero(t.topics.select("id", "name"), links, "id", "n").orderBy(F.desc("n"), "id").limit(25)


@query("A11_alert_counts", f"""SELECT asset_id, count(*) AS n, arg_min(severity,
      CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS worst
    FROM (SELECT *, {WIDE} AS w
    FROM (SELECT *, {VALID} AS d
    FROM alerts))
    WHERE w >= DATE '2023-07-31'
    GROUP BY asset_id""")
def a11(t):
    now = F.expr(NOW)
    return t.alerts.filter(dates.is_current(F.col("event_date"), now, 6)).groupBy("asset_id").agg(F.count("*").alias("n"), F.min_by("severity", dates.severity_rank(F.col("severity"))).alias("worst"))


@query("A12_review_groups", "SELECT topic_id, count(*) AS n, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS claims FROM claims WHERE status = 'flagged' GROUP BY topic_id")
def a12(t):
    ids = F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))
    return t.claims.filter("status = 'flagged'").groupBy("topic_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("claims"))


@query("A13_run_counters", """SELECT rel, count(*) AS n, count(*) FILTER (WHERE source_id % 3 = 0) AS removed, count(*) FILTER (WHERE source_id % 3 <> 0) AS n_after
    FROM topic_edges
    GROUP BY rel""")
def a13(t):
    gone = F.col("source_id") % 3 == 0
    return t.topic_edges.groupBy("rel").agg(F.count("*").alias("n"), F.count(F.when(gone, 1)).alias("removed"), F.count(F.when(~gone, 1)).alias("n_after"))


@query("A14_coverage", """SELECT count(*) AS assets, count(s.asset_id) AS researched, count(*) - count(s.asset_id) AS never_researched,
      count(*) FILTER (WHERE s.urgent > 0) AS urgent
    FROM assets a
    LEFT
    JOIN (SELECT asset_id, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS urgent
    FROM alerts
    GROUP BY asset_id) s ON s.asset_id = a.id""")
def a14(t):
    seen = t.alerts.groupBy(F.col("asset_id").alias("id")).agg(F.count(F.when(F.col("severity").isin("critical", "high"), 1)).alias("urgent"))
    rows = t.assets.select("id").join(seen, "id", "left")
    return rows.agg(F.count("*").alias("assets"), F.count("urgent").alias("researched"), F.count(F.when(F.col("urgent").isNull(), 1)).alias("never_researched"), F.count(F.when(F.col("urgent") > 0, 1)).alias("urgent"))


@query("W01_rank_by_score", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def w01(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rank"))


@query("W02_best_per_group", """SELECT l_partkey, l_orderkey, l_linenumber, n
    FROM (SELECT l_partkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r
    FROM lineitem)
    WHERE r = 1""")
def w02(t):
    best = t.lineitem.groupBy("l_partkey").agg(F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("b"), F.count("*").alias("n"))
    return best.select("l_partkey", "b.l_orderkey", "b.l_linenumber", "n")


@query("W03_cap_one_status", """SELECT id, topic_id, status
    FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, status
    ORDER BY created_at, id) AS r
    FROM claims)
    WHERE status <> 'conflicted' OR r <= 3""")
def w03(t):
    w = Window.partitionBy("topic_id", "status").orderBy("created_at", "id")
    return t.claims.withColumn("r", F.row_number().over(w)).filter("status <> 'conflicted' OR r <= 3").select("id", "topic_id", "status")


@query("W04_spread_sample", """SELECT category, topic_id, id
    FROM (SELECT category, topic_id, id, row_number() OVER (PARTITION BY category
    ORDER BY topic_id, id) AS q
    FROM (SELECT t.category, c.topic_id, c.id, row_number() OVER (PARTITION BY c.topic_id
    ORDER BY c.id) AS r, k.n
    FROM claims c
    JOIN topics t ON t.id = c.topic_id
    JOIN (SELECT category, count(*) AS n
    FROM topics
    GROUP BY category) k ON k.category = t.category)
    WHERE r <= ceil(40.0 / n))
    WHERE q <= 40""")
def w04(t):
    topics = t.topics.filter("category IS NOT NULL").select(F.col("id").alias("topic_id"), "category")
    n = topics.groupBy("category").agg(F.count("*").alias("n"))
    rows = t.claims.select("id", "topic_id").join(topics, "topic_id").join(n, "category")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy("id"))).filter(F.col("r") <= F.ceil(40 / F.col("n")))
    return r.first_per(rows, ["category"], [F.col("topic_id"), F.col("id")], 40).select("category", "topic_id", "id")


@query("W05_leaders_of_half", """SELECT min(rank) AS leaders
    FROM (SELECT n, row_number() OVER (ORDER BY n DESC, p_brand) AS rank, sum(n) OVER (ORDER BY n DESC, p_brand) AS run, sum(n) OVER () AS total
    FROM (SELECT p_brand, count(*) AS n
    FROM part
    GROUP BY p_brand))
    WHERE run * 2 >= total""")
def w05(t):
    return r.running_half(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), [], "n")


@query("W06_neighbour_text", """SELECT conv_id, turn, right(coalesce(lag(text) OVER w, ''), 800) AS before, left(coalesce(lead(text) OVER w, ''), 800) AS after
    FROM conversations
    WINDOW w AS (PARTITION BY conv_id
    ORDER BY turn)""")
def w06(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.right(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(800)).alias("before"), F.left(F.coalesce(F.lead("text").over(w), F.lit("")), F.lit(800)).alias("after"))


@query("W07_keep_first_key", """SELECT id, CASE WHEN r = 1 THEN name END AS name, r > 1 AS collides
    FROM (SELECT id, name, row_number() OVER (PARTITION BY name
    ORDER BY id) AS r
    FROM topics)""")
def w07(t):
    return r.keep_first_key(t.topics.select("id", "name"), "name", "id")


@query("W08_answer_pairs", """SELECT conv_id, turn, asked, answered
    FROM (SELECT conv_id, turn, role, text AS answered, lag(text) OVER w AS asked, lag(role) OVER w AS before
    FROM conversations
    WINDOW w AS (PARTITION BY conv_id
    ORDER BY turn))
    WHERE role = 'assistant' AND before = 'user'""")
def w08(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("answered"), F.lag("text").over(w).alias("asked"), F.lag("role").over(w).alias("before"))
    return rows.filter("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "asked", "answered")


@query("W09_timeline", f"""SELECT id, round(greatest(0, least(1, date_diff('day', {NOW}, end_date) / greatest(1.0, (SELECT date_diff('day', {NOW}, max(end_date))
    FROM assets)))), 6) AS place
    FROM assets
    WHERE end_date IS NOT NULL""")
def w09(t):
    last = t.assets.agg(F.max("end_date").alias("last"))
    away = lambda c: F.date_diff(c, F.expr(NOW))
    rows = t.assets.filter("end_date IS NOT NULL").select("id", "end_date").join(F.broadcast(last), how="cross")  # last is one row
    return rows.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), away(F.col("end_date")) / F.greatest(F.lit(1.0), away(F.col("last"))))), 6).alias("place"))


@query("W10_renumber_groups", "SELECT id, dense_rank() OVER (ORDER BY low) AS group_no FROM (SELECT id, min(id) OVER (PARTITION BY name) AS low FROM topics)")
def w10(t):
    groups = t.topics.groupBy("name").agg(F.min("id").alias("low"))
    return t.topics.select("id", "name").join(r.numbered(groups, [F.col("low")], "group_no").hint("merge"), "name").select("id", "group_no")


@query("L01_page", """SELECT id, name, (SELECT count(*)
    FROM topics) AS total, CAST(ceil((SELECT count(*)
    FROM topics) / 20.0) AS BIGINT) AS n_pages
    FROM topics
    ORDER BY name, id LIMIT 20 OFFSET 40""")
def l01(t):
    return r.page(t.topics.select("id", "name"), [F.col("name"), F.col("id")], 3, 20)


@query("L02_topic_page", """SELECT t.id, t.name, coalesce(c.n, 0) AS n_claims, coalesce(d.n, 0) AS degree
    FROM topics t
    LEFT
    JOIN (SELECT topic_id, count(*) AS n
    FROM claims
    WHERE status = 'active'
    GROUP BY 1) c ON c.topic_id = t.id
    LEFT
    JOIN (SELECT target_id, count(*) AS n
    FROM topic_edges
    GROUP BY 1) d ON d.target_id = t.id + 1000000
    WHERE t.category IS NOT NULL
    ORDER BY n_claims DESC, degree DESC, t.id LIMIT 20""")
def l02(t):
    rows = r.counts_with_zero(t.topics.filter("category IS NOT NULL").select("id", "name"), t.claims.filter("status = 'active'").select(F.col("topic_id").alias("id")), "id", "n_claims")
    rows = r.counts_with_zero(rows, t.topic_edges.select((F.col("target_id") - 1000000).alias("id")), "id", "degree")
    return r.page(rows, [F.desc("n_claims"), F.desc("degree"), F.col("id")]).drop("total", "n_pages")


@query("L03_claim_page", """SELECT c.id, c.claim_text, t.name, c.status
    FROM claims c
    JOIN topics t ON t.id = c.topic_id
    WHERE c.status = 'superseded' AND contains(lower(c.claim_text), 'n o')
    ORDER BY c.created_at DESC, c.id LIMIT 20""")
def l03(t):
    rows = t.claims.filter("status = 'superseded'").filter(F.contains(F.lower("claim_text"), F.lit("n o"))).join(t.topics.select(F.col("id").alias("topic_id"), "name"), "topic_id")
    return r.page(rows, [F.desc("created_at"), F.col("id")]).select("id", "claim_text", "name", "status")


@query("L04_nulls_last", "SELECT id, fit FROM assets ORDER BY fit DESC NULLS LAST, id LIMIT 120")
def l04(t):
    return t.assets.select("id", "fit").orderBy(F.col("fit").desc_nulls_last(), "id").limit(120)


@query("L05_order_by_list", """SELECT id, severity
    FROM alerts
    ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END, id LIMIT 700""")
def l05(t):
    return t.alerts.select("id", "severity").orderBy(*r.by_list(F.col("severity"), list(dates.SEVERITIES)), "id").limit(700)


@query("L06_capped_list", """SELECT id, name, (SELECT count(*)
    FROM assets
    WHERE fit IS NULL) AS total, (SELECT count(*)
    FROM assets
    WHERE fit IS NULL) > 500 AS truncated
    FROM assets
    WHERE fit IS NULL
    ORDER BY lower(name), id LIMIT 500""")
def l06(t):
    return r.capped(t.assets.filter("fit IS NULL").select("id", "name"), [F.lower("name"), F.col("id")])


@query("L07_pinned_first", "SELECT conv_id, pinned FROM chats WHERE user_id < 25 ORDER BY pinned DESC, last_turn DESC, conv_id LIMIT 30")
def l07(t):
    return t.chats.filter("user_id < 25").orderBy(F.desc("pinned"), F.desc("last_turn"), "conv_id").select("conv_id", "pinned").limit(30)


@query("U01_best_of_lists", """SELECT id, max(score) AS score
    FROM (SELECT l_partkey AS id, max(l_quantity) AS score
    FROM lineitem
    WHERE l_returnflag = 'A'
    GROUP BY 1
    UNION ALL SELECT l_partkey, avg(l_quantity)
    FROM lineitem
    WHERE l_returnflag = 'N'
    GROUP BY 1)
    GROUP BY id""")
def u01(t):
    hits = lambda flag, f: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("id")).agg(f("l_quantity").alias("score"))
    return r.best_of([hits("A", F.max), hits("N", F.avg)], "id", "score").select("id", "score")


@query("U02_ordered_union", """SELECT name, min(place) AS place
    FROM (SELECT n_name AS name, n_nationkey AS place
    FROM nation
    UNION ALL SELECT p_type, 1000 + min(p_partkey)
    FROM part
    GROUP BY p_type
    UNION ALL SELECT n_name, 1000 + n_nationkey
    FROM nation)
    GROUP BY name""")
def u02(t):
    base = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("at"))
    new = t.part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("at")).unionByName(base)
    return r.ordered_union(base, new, "name", "at").select("name", (F.col("p.list") * 1000 + F.col("p.at")).alias("place"))


@query("U03_insert_if_absent", "SELECT source_id, target_id FROM topic_edges WHERE rel = 'references' UNION SELECT source_id, target_id FROM topic_edges WHERE rel = 'depends_on'")
def u03(t):
    of = lambda rel: t.topic_edges.filter(F.col("rel") == rel).select("source_id", "target_id")
    return r.insert_if_absent(of("references"), of("depends_on"), ["source_id", "target_id"])
