"""Queries of portfolio and usage analytics (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstead.functions import dates
from loomstead.functions.text import label, words_key
from loomstead.operators import portfolio as p
from loomstead.operators import relational as r
from loomstead.plans.basics import VALID
from loomstead.plans.columns import NOW, REACH, WIDE
from loomstead.plans.registry import INPUTS, query
from loomstead.storage import sized_cross


def reach(t):
    """Far ends of each asset; relations are distinct, so they are just counted."""
    return t.relations.filter("rel = 'serves'").groupBy(F.col("from_id").alias("id")).agg(F.count("to_id").alias("reach"))


@query("P01_headline", """SELECT count(*) AS n, count(*) FILTER (WHERE fs_type = 'Platform') AS platforms,
      count(*) FILTER (WHERE end_date IS NOT NULL OR lifecycle IN ('phaseOut', 'endOfLife')) AS ending, round(avg(completion), 6) AS completeness,
      (SELECT count(DISTINCT to_id)
    FROM relations
    WHERE rel = 'vendor') AS vendors, (SELECT count(DISTINCT to_id)
    FROM relations
    WHERE rel = 'capability') AS capabilities
    FROM assets""")
def p01(t):
    ending = F.col("end_date").isNotNull() | F.col("lifecycle").isin("phaseOut", "endOfLife")
    a = t.assets.agg(F.count("*").alias("n"), F.count(F.when(F.col("fs_type") == "Platform", 1)).alias("platforms"), F.count(F.when(ending, 1)).alias("ending"), F.round(F.avg("completion"), 6).alias("completeness"))
    far = lambda rel: F.count_distinct(F.when(F.col("rel") == rel, F.col("to_id")))
    e = t.relations.agg(far("vendor").alias("vendors"), far("capability").alias("capabilities"))
    return a.join(F.broadcast(e), how="cross")  # a row each


@query("P02_breakdown", """SELECT CASE lifecycle WHEN 'plan' THEN 'Plan' WHEN 'phaseIn' THEN 'Phase in' WHEN 'active' THEN 'Active'
      WHEN 'phaseOut' THEN 'Phase out' WHEN 'endOfLife' THEN 'End of life' ELSE 'Not set' END AS label, count(*) AS n
    FROM assets
    GROUP BY lifecycle""")
def p02(t):
    return t.assets.groupBy("lifecycle").agg(F.count("*").alias("n")).select(label(F.col("lifecycle")).alias("label"), "n")


@query("P03_platform_load", f"SELECT id, name, lifecycle, reach FROM assets JOIN ({REACH}) r ON r.from_id = id ORDER BY reach DESC, id LIMIT 15")
def p03(t):
    return t.assets.join(reach(t), "id").select("id", "name", "lifecycle", "reach").orderBy(F.desc("reach"), "id").limit(15)


@query("P04_vendor_concentration", """SELECT s_name, count(DISTINCT l_partkey) AS n_parts
    FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY s_name
    ORDER BY n_parts DESC, s_name LIMIT 15""")
def p04(t):
    parts = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"))
    named = t.supplier.select("s_suppkey", "s_name")
    return parts.join(named, parts.l_suppkey == named.s_suppkey).select("s_name", "n_parts").orderBy(F.desc("n_parts"), "s_name").limit(15)


@query("P05_concentration_statistics", """SELECT count(*) AS n_groups, CAST(max(total) AS BIGINT) AS total, round(max(n) / max(total), 6) AS top_share,
      min(rank) FILTER (WHERE run * 2 >= total) AS to_half, CAST(sum(n) FILTER (WHERE rank <= 5) AS BIGINT) AS top_sum,
      CAST(sum(n) FILTER (WHERE rank > 5) AS BIGINT) AS rest
    FROM (SELECT n, row_number() OVER w AS rank, sum(n) OVER w AS run, sum(n) OVER () AS total
    FROM (SELECT to_name, count(DISTINCT from_id) AS n
    FROM relations
    WHERE rel = 'vendor'
    GROUP BY 1)
    WINDOW w AS (ORDER BY n DESC, to_name))""")
def p05(t):
    return p.concentration_statistics(p.concentration(t.relations, "vendor"), "n")


@query("P06_thin_ends", """SELECT count(*) AS n_groups, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS most
    FROM (SELECT count(DISTINCT from_id) AS n
    FROM relations
    WHERE rel = 'serves'
    GROUP BY to_id)""")
def p06(t):
    n = t.relations.filter("rel = 'serves'").groupBy("to_id").agg(F.count_distinct("from_id").alias("n"))
    return n.agg(F.count("*").alias("n_groups"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.max("n").alias("most"))


@query("P07_dense_matrix", """SELECT c.criticality, l.lifecycle, count(a.id) AS n
    FROM (SELECT DISTINCT criticality
    FROM assets) c
    CROSS
    JOIN (SELECT DISTINCT lifecycle
    FROM assets) l
    LEFT
    JOIN assets a ON a.criticality IS NOT DISTINCT
    FROM c.criticality AND a.lifecycle IS NOT DISTINCT
    FROM l.lifecycle
    GROUP BY 1, 2""")
def p07(t):
    return p.dense_matrix(t.assets, "criticality", "lifecycle")


@query("P08_runway", f"""SELECT id, name, round(date_diff('day', {NOW}, end_date) / 30.44, 6) AS months, end_date < {NOW} AS started, coalesce(reach, 0) AS reach
    FROM assets
    LEFT
    JOIN ({REACH}) r ON r.from_id = id
    WHERE end_date IS NOT NULL
    ORDER BY end_date, id LIMIT 25""")
def p08(t):
    return p.runway(t.assets, reach(t), F.expr(NOW)).orderBy("months", "id").limit(25)


@query("P09_action_gap", f"""SELECT id, reach, concat_ws(',', CASE WHEN end_date IS NOT NULL OR lifecycle IN ('phaseOut', 'endOfLife') THEN 'ending' END,
      CASE WHEN fit = 'unreasonable' THEN 'poor fit' END) AS reasons, id IN (SELECT from_id
    FROM relations
    WHERE rel = 'org' AND to_id LIKE '%1') AS planned
    FROM assets
    JOIN ({REACH}) r ON r.from_id = id
    WHERE reach >= 20 AND (end_date IS NOT NULL OR lifecycle IN ('phaseOut', 'endOfLife') OR fit = 'unreasonable')""")
def p09(t):
    planned = t.relations.filter("rel = 'org' AND to_id LIKE '%1'").select(F.col("from_id").alias("id"))
    return p.action_gap(t.assets, reach(t), planned, ["unreasonable", "inappropriate"])


@query("P10_ownership", "SELECT to_name AS owner, count(DISTINCT from_id) AS n FROM relations WHERE rel IN ('org', 'vendor') GROUP BY 1 ORDER BY n DESC, owner LIMIT 12")
def p10(t):
    rows = t.relations.filter(F.col("rel").isin("org", "vendor")).groupBy(F.col("to_name").alias("owner")).agg(F.count_distinct("from_id").alias("n"))
    return rows.orderBy(F.desc("n"), "owner").limit(12)


@query("P11_record_gaps", """SELECT count(*) FILTER (WHERE fit IS NULL) AS no_fit, count(*) FILTER (WHERE criticality IS NULL) AS no_criticality,
      count(*) FILTER (WHERE lifecycle IS NULL) AS no_lifecycle, count(*) FILTER (WHERE id NOT IN (SELECT from_id
    FROM relations
    WHERE rel = 'capability')) AS no_capability, count(*) FILTER (WHERE id NOT IN (SELECT from_id
    FROM relations
    WHERE rel = 'vendor')) AS no_vendor
    FROM assets""")
def p11(t):
    has = t.relations.groupBy(F.col("from_id").alias("id")).agg(F.bool_or(F.col("rel") == "capability").alias("c"), F.bool_or(F.col("rel") == "vendor").alias("v"))
    none = lambda c, n: F.count(F.when(c, 1)).alias(n)
    rows = t.assets.join(has, "id", "left")
    return rows.agg(none(F.col("fit").isNull(), "no_fit"), none(F.col("criticality").isNull(), "no_criticality"), none(F.col("lifecycle").isNull(), "no_lifecycle"), none(~F.coalesce("c", F.lit(False)), "no_capability"), none(~F.coalesce("v", F.lit(False)), "no_vendor"))


@query("P12_asset_table", """SELECT a.id, a.name, string_agg(r.to_name, ', '
    ORDER BY r.to_name) FILTER (WHERE r.rel <> 'serves') AS far_ends, count(*) FILTER (WHERE r.rel = 'serves') AS n_serves
    FROM assets a
    LEFT
    JOIN relations r ON r.from_id = a.id
    GROUP BY a.id, a.name""")
def p12(t):
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("rel") != "serves", F.col("to_name")))), ", ")
    far = t.relations.groupBy(F.col("from_id").alias("id")).agg(F.nullif(names, F.lit("")).alias("far_ends"), F.count(F.when(F.col("rel") == "serves", 1)).alias("n_serves"))
    return t.assets.select("id", "name").join(far, "id", "left").withColumn("n_serves", F.coalesce("n_serves", F.lit(0)))


INPUTS["drill_assets"] = """
SELECT a.*, CASE WHEN completion % 4 = 0 THEN NULL WHEN completion % 4 = 1 THEN '' ELSE name END AS description,
  CASE completion % 5 WHEN 0 THEN 'tolerate' WHEN 1 THEN 'invest' WHEN 2 THEN 'migrate' WHEN 3 THEN 'eliminate' END AS time_class,
  CASE completion % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'confidential' END AS data_class FROM assets a"""
INPUTS["drill_edges"] = "SELECT from_id, rel, to_name FROM relations UNION ALL SELECT id, 'business', category FROM assets WHERE fs_type = 'Platform'"
INPUTS["drill_roles"] = """
SELECT id, CASE WHEN completion % 2 = 0 THEN 'RESPONSIBLE' ELSE 'OBSERVER' END AS kind,
  CASE WHEN completion % 3 = 0 THEN 'architect' ELSE 'owner' END AS role FROM assets WHERE completion % 7 <> 0"""
INPUTS["drill_research"] = """
SELECT id, completion % 4 <> 0 AS identified,
  CASE completion % 3 WHEN 0 THEN 'solid' WHEN 1 THEN 'replace' ELSE 'adequate' END AS verdict FROM assets WHERE completion % 2 = 0"""
NEAR = "id IN (SELECT from_id FROM drill_edges WHERE rel = '{}' AND to_name = '{}')"
#: Dimension, keys, and the same predicate in SQL.
DRILLS = [
    ("all", "", "", "true"),
    ("type", "Product", "", "fs_type = 'Product'"),
    ("lifecycle", "", "", "lifecycle IS NULL"),
    ("fit", "appropriate", "", "fit = 'appropriate'"),
    ("category", "ECONOMY", "", "fs_type = 'Product' AND category = 'ECONOMY'"),
    ("time", "", "", "fs_type = 'Platform' AND time_class IS NULL"),
    ("time", "migrate", "", "fs_type = 'Platform' AND time_class = 'migrate'"),
    ("criticality", "missionCritical", "", "fs_type = 'Platform' AND criticality = 'missionCritical' AND data_class IS NULL"),
    ("criticality", "", "public", "fs_type = 'Platform' AND criticality IS NULL AND data_class = 'public'"),
    ("gap", "no_description", "", "coalesce(description, '') = ''"),
    ("gap", "no_fit", "", "fit IS NULL"),
    ("gap", "no_lifecycle", "", "lifecycle IS NULL"),
    ("gap", "no_owner", "", "id NOT IN (SELECT id FROM drill_roles WHERE kind = 'RESPONSIBLE')"),
    ("gap", "no_capability", "", "fs_type = 'Product' AND id NOT IN (SELECT from_id FROM drill_edges WHERE rel = 'capability')"),
    ("verdict", "solid", "", "id IN (SELECT id FROM drill_research WHERE identified AND verdict = 'solid')"),
    ("vendor", "Brand#7", "", NEAR.format("vendor", "Brand#7")),
    ("capability", "ECONOMY", "", NEAR.format("capability", "ECONOMY")),
    ("business_capability", "NATION_3", "", NEAR.format("business", "NATION_3")),
    ("organisation", "NATION_3", "", NEAR.format("org", "NATION_3")),
    ("role", "architect", "", "id IN (SELECT id FROM drill_roles WHERE kind = 'RESPONSIBLE' AND role = 'architect')"),
]


def drilled(t, dimension, key, key2):
    found = p.drill(p.Portfolio(t.drill_assets, t.drill_edges, t.drill_roles, t.drill_research, "Product", "Platform"), dimension, key, key2)
    return r.capped(found.select("id", "name"), [F.lower("name"), F.col("id")])


for dimension_, key_, key2_, where in DRILLS:
    title = "_".join(x for x in ("P13_drill", dimension_, key_.replace("#", ""), key2_) if x)
    total = f"SELECT count(*) AS total FROM drill_assets WHERE {where}"
    query(title, f"SELECT id, name, ({total}) AS total, ({total}) > 500 AS truncated FROM drill_assets WHERE {where} ORDER BY lower(name), id LIMIT 500")(
        lambda t, args=(dimension_, key_, key2_): drilled(t, *args)
    )


@query("P14_platform_edges", """SELECT to_id, coalesce(to_name, to_id) AS name, lifecycle, (SELECT count(*)
    FROM relations
    WHERE from_id = 'S5' AND rel = 'serves') AS total
    FROM relations r
    LEFT
    JOIN assets a ON a.id = r.to_id
    WHERE from_id = 'S5' AND rel = 'serves'
    ORDER BY name, to_id LIMIT 500""")
def p14(t):
    edges = t.relations.filter("from_id = 'S5' AND rel = 'serves'").join(t.assets.select(F.col("id").alias("to_id"), "lifecycle"), "to_id", "left")
    return r.capped(edges.select("to_id", F.coalesce("to_name", "to_id").alias("name"), "lifecycle"), [F.col("name"), F.col("to_id")]).drop("truncated")


@query("P15_group_drill", "SELECT to_name AS name, count(DISTINCT from_id) AS n FROM relations WHERE rel = 'vendor' GROUP BY 1 HAVING count(DISTINCT from_id) > 1")
def p15(t):
    return p.concentration(t.relations, "vendor").filter("n > 1")


CAP = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def taxonomy(t):
    """Lookup tables by level: aliases, market segments (level 3), nations (2), regions (1)."""
    alias = t.spark.createDataFrame([("shop", "BUILDING"), ("motor", "AUTOMOBILE")], "key string, node string")
    keyed = lambda df, c: df.select(words_key(F.col(c)).alias("key"), F.col(c).alias("node")).distinct()
    return [("alias", alias), ("3", keyed(t.customer, "c_mktsegment")), ("2", keyed(t.nation.filter("n_nationkey % 4 <> 0"), "n_name")), ("1", keyed(t.region, "r_name"))]


@query("P16_taxonomy_resolution", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN c_mktsegment WHEN 2 THEN CASE WHEN c_nationkey % 4 <> 0 THEN n_name END WHEN 3 THEN r_name END AS node, CASE c_custkey % 5 WHEN 0 THEN 'alias' WHEN 1 THEN '3' WHEN 2 THEN CASE WHEN c_nationkey % 4 <> 0 THEN '2' END WHEN 3 THEN '1' END AS level
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def p16(t):
    said = F.when(F.col("c_custkey") % 5 == 0, F.lit("Shop")).when(F.col("c_custkey") % 5 == 1, F.lower("c_mktsegment")).when(F.col("c_custkey") % 5 == 2, F.replace("n_name", F.lit("_"), F.lit(" - "))).when(F.col("c_custkey") % 5 == 3, F.lower("r_name")).otherwise("nowhere")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return p.resolve(rows.select("c_custkey", said.alias("said")), words_key(F.col("said")), taxonomy(t)).select("c_custkey", "node", "level")


INPUTS["sub_towers"] = "SELECT n_name AS sub_tower, r_name AS tower FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0 OR n_regionkey < 2"


@query(
    "P17_tower_resolution",
    """WITH lone AS (SELECT tower, min(sub_tower) AS sub_tower FROM sub_towers GROUP BY tower HAVING count(*) = 1),
    found AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (SELECT min(sub_tower) FROM sub_towers) WHEN 1 THEN s.sub_tower WHEN 2 THEN l.sub_tower END AS sub_tower
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN sub_towers s ON s.sub_tower = n_name LEFT JOIN lone l ON l.tower = r_name)
    SELECT c_custkey, f.sub_tower, tower FROM found f LEFT JOIN sub_towers s ON s.sub_tower = f.sub_tower""",
)
def p17(t):
    """By alias, by sub-tower, or by a tower that has exactly one sub-tower; other towers stay unresolved."""
    subs = t.sub_towers
    lone = subs.groupBy("tower").agg(F.min("sub_tower").alias("node"), F.count("*").alias("n")).filter("n = 1")
    alias = subs.agg(F.min("sub_tower").alias("node")).select(F.lit("main hub").alias("key"), "node")
    tables = [("alias", alias), ("sub", subs.select(words_key(F.col("sub_tower")).alias("key"), F.col("sub_tower").alias("node"))), ("tower", lone.select(words_key(F.col("tower")).alias("key"), "node"))]
    said = F.when(F.col("c_custkey") % 4 == 0, " Main-Hub").when(F.col("c_custkey") % 4 == 1, F.lower("n_name")).when(F.col("c_custkey") % 4 == 2, F.concat(F.col("r_name"), F.lit("!"))).otherwise("nowhere")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", said.alias("said"))
    found = p.resolve(rows, words_key(F.col("said")), tables).select("c_custkey", F.col("node").alias("sub_tower"))
    return found.join(subs, "sub_tower", "left").select("c_custkey", "sub_tower", "tower")


@query("P18_coverage_map", """SELECT r_name, n_name, c_mktsegment, count(DISTINCT c_custkey) AS members, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS covered
    FROM (SELECT r_name, n_name, s.c_mktsegment, c.c_custkey, c.c_acctbal
    FROM nation
    JOIN region ON n_regionkey = r_regionkey
    CROSS
    JOIN (SELECT DISTINCT c_mktsegment
    FROM customer) s
    LEFT
    JOIN customer c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_custkey % 3 = 0)
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def p18(t):
    segments = t.customer.select(F.col("c_mktsegment").alias("seg")).distinct()
    frame = sized_cross(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), segments)
    c = t.customer.filter("c_custkey % 3 = 0")
    rows = frame.join(c, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_mktsegment") == F.col("seg")), "left").drop("c_mktsegment").withColumnRenamed("seg", "c_mktsegment")
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count_distinct("c_custkey").alias("members"), F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("covered"))


@query("P19_reasons_per_cell", "SELECT to_name AS cell, from_id AS asset, string_agg(DISTINCT rel, ',' ORDER BY rel) AS reasons FROM relations WHERE rel <> 'serves' GROUP BY 1, 2")
def p19(t):
    return t.relations.filter("rel <> 'serves'").groupBy(F.col("to_name").alias("cell"), F.col("from_id").alias("asset")).agg(F.array_join(F.sort_array(F.collect_set("rel")), ",").alias("reasons"))


@query("P20_alias_checks", "SELECT node, 'unknown node' AS problem FROM (SELECT DISTINCT p_type AS node FROM part) WHERE node NOT IN (SELECT c_mktsegment FROM customer)")
def p20(t):
    aliases = t.part.select(F.col("p_type").alias("node")).distinct()
    return aliases.join(t.customer.select(F.col("c_mktsegment").alias("node")).distinct(), "node", "left_anti").withColumn("problem", F.lit("unknown node"))


FEED = f"""SELECT id, asset_id, title, event_date, severity, w
    FROM (SELECT *, {WIDE} AS w
    FROM (SELECT *, {VALID} AS d
    FROM alerts))
    WHERE w >= DATE '2023-07-31'"""
IREACH = "SELECT to_id, count(DISTINCT from_id) AS reach FROM relations WHERE rel = 'serves' GROUP BY to_id"


@query("P21_alert_feed", f"""SELECT f.id, f.title, round(CASE f.severity WHEN 'critical' THEN 1000 WHEN 'high' THEN 300 WHEN 'medium' THEN 60 WHEN 'low' THEN 10 ELSE 1 END * (1 + log10(1 + coalesce(reach, 0))), 4) AS exposure
    FROM ({FEED}) f
    LEFT
    JOIN ({IREACH}) r ON r.to_id = f.asset_id
    ORDER BY exposure DESC, w DESC, title, f.id LIMIT 60""")
def p21(t):
    wide = p.far_counts(t.relations, "serves", "to_id", "from_id").withColumnRenamed("to_id", "asset_id")
    rows = t.alerts.filter(dates.is_current(F.col("event_date"), F.expr(NOW), 6)).join(wide, "asset_id", "left")
    rows = rows.select("id", "title", F.round(dates.exposure(F.col("severity"), F.col("reach")), 4).alias("exposure"), dates.widened(F.col("event_date")).alias("w"))
    return rows.orderBy(F.desc("exposure"), F.desc_nulls_last("w"), "title", "id").limit(60).drop("w")


@query("P22_exposure_summary", f"""SELECT count(DISTINCT asset_id) AS exposed, (SELECT count(DISTINCT from_id)
    FROM relations
    WHERE rel = 'serves' AND to_id IN (SELECT asset_id
    FROM ({FEED})
    WHERE severity IN ('critical', 'high'))) AS far_ends
    FROM ({FEED})
    WHERE severity IN ('critical', 'high')""")
def p22(t):
    urgent = t.alerts.filter(dates.is_current(F.col("event_date"), F.expr(NOW), 6) & F.col("severity").isin("critical", "high")).select(F.col("asset_id").alias("to_id")).distinct()
    far = t.relations.filter("rel = 'serves'").join(urgent, "to_id", "left_semi").agg(F.count_distinct("from_id").alias("far_ends"))
    return urgent.agg(F.count("*").alias("exposed")).join(F.broadcast(far), how="cross")  # a row each


@query("P23_verdicts", "SELECT fit AS verdict, count(*) AS n FROM assets WHERE fit IS NOT NULL GROUP BY fit")
def p23(t):
    return t.assets.filter("fit IS NOT NULL").groupBy(F.col("fit").alias("verdict")).agg(F.count("*").alias("n"))


@query("P24_disagreements", """SELECT id, fit, criticality, CASE WHEN fit = 'appropriate' THEN 'over' ELSE 'under' END AS direction
    FROM assets
    WHERE (fit = 'appropriate' AND criticality IS NULL) OR (fit IN ('inappropriate', 'unreasonable') AND criticality = 'missionCritical')""")
def p24(t):
    over, under = (F.col("fit") == "appropriate") & F.col("criticality").isNull(), F.col("fit").isin("inappropriate", "unreasonable") & (F.col("criticality") == "missionCritical")
    return t.assets.filter(over | under).select("id", "fit", "criticality", F.when(over, "over").otherwise("under").alias("direction"))


@query("P25_assessments", "SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS INT), event_id) AS k, count(*) AS n FROM events GROUP BY user_id")
def p25(t):
    k = F.from_json("props", "k int")["k"]
    return t.events.groupBy("user_id").agg(F.max_by(k, "event_id").alias("k"), F.count("*").alias("n"))


SERIES = """SELECT c.category, CAST(make_timestamp(b.at * 1000000) AS STRING) AS bucket, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total, count(u.id) AS calls, CAST(coalesce(sum(total_tokens) FILTER (WHERE estimated = 1), 0) AS BIGINT) AS estimated_tokens
FROM (SELECT CAST(floor((epoch(TIMESTAMP '2024-01-31 12:00:00') + 3600) / ({h} * 3600)) * {h} * 3600 - 3600 - i * {h} * 3600 AS BIGINT) AS at FROM range({n}) x(i)) b CROSS JOIN (SELECT unnest(['chat', 'documents', 'knowledge', 'market', 'other']) AS category) c
LEFT JOIN (SELECT *, CASE WHEN category IN ('chat', 'documents', 'knowledge', 'market') THEN category ELSE 'other' END AS folded, CAST(floor((epoch(date_trunc('second', created_at)) + 3600) / ({h} * 3600)) * {h} * 3600 - 3600 AS BIGINT) AS at FROM usage_log) u ON u.at = b.at AND u.folded = c.category GROUP BY c.category, b.at"""


def series(t, hours, n):
    return p.usage_series(t.usage_log, F.expr("TIMESTAMP '2024-01-31 12:00:00'"), hours, n, 60, ["chat", "documents", "knowledge", "market"], t.spark)


query("P26_usage_daily", SERIES.format(h=24, n=30))(lambda t: series(t, 24, 30))
query("P26_usage_six_hourly", SERIES.format(h=6, n=28))(lambda t: series(t, 6, 28))
query("P26_usage_hourly", SERIES.format(h=1, n=24))(lambda t: series(t, 1, 24))


@query("P27_window_totals", f"SELECT category, CAST(sum(total) AS BIGINT) AS total, CAST(sum(calls) AS BIGINT) AS calls FROM ({SERIES.format(h=24, n=30)}) GROUP BY category")
def p27(t):
    return series(t, 24, 30).groupBy("category").agg(F.sum("total").alias("total"), F.sum("calls").alias("calls"))


@query("P28_transcripts", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def p28(t):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["said"]), "\n").alias("transcript"))
