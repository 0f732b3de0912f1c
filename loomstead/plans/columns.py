"""Queries of predicates (F) and column functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstead.functions import dates, repair, text
from loomstead.operators import predicates as p
from loomstead.plans.registry import query

#: The queries' "now".
NOW = "DATE '2024-01-31'"


@query("F01_literal_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def f01(t):
    return t.part.filter(p.contains(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query("F02_folded_search", """SELECT id, name
    FROM topics
    WHERE contains(lower(name), 'red bolt') OR contains(lower(description),
      'red bolt') OR contains(trim(regexp_replace(regexp_replace(lower(name), '[-\\s]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), 'red bolt')""")
def f02(t):
    return t.topics.filter(p.folded_search(F.col("name"), F.col("description"), "Red Bolt")).select("id", "name")


@query("F03_eq_or_null", "SELECT id, fit FROM assets WHERE fit IS NULL")
def f03(t):
    return t.assets.filter(p.eq_or_null(F.col("fit"), "")).select("id", "fit")


@query("F04_ignored_path", """SELECT id, path, regexp_matches(path, '(^|[\\\\/])!') AS ignored
    FROM (SELECT id, CASE WHEN id % 3 = 0 THEN replace(path, '/src1', '/!src1') ELSE path END AS path
    FROM snapshot_old)""")
def f04(t):
    paths = t.snapshot_old.select("id", F.when(F.col("id") % 3 == 0, F.replace("path", F.lit("/src1"), F.lit("/!src1"))).otherwise(F.col("path")).alias("path"))
    return paths.withColumn("ignored", p.ignored_path(F.col("path")))


@query("F05_status_by_role", "SELECT id, status FROM claims WHERE status = 'active'")
def f05(t):
    return t.claims.filter(p.visible_status(F.col("status"), "superseded", "editor")).select("id", "status")


WIDE = """CASE WHEN length(d) = 4 THEN make_date(CAST(d AS INT), 12, 31) WHEN length(d) = 7 THEN last_day(try_cast(d || '-01' AS DATE)) ELSE try_cast(d AS DATE) END"""


@query("F06_current_events", f"""SELECT id, event_date, {WIDE} >= DATE '2023-07-31' AS current_event
    FROM (SELECT id, event_date, event_date AS d
    FROM alerts
    WHERE try_cast(CASE length(event_date) WHEN 4 THEN event_date || '-01-01' WHEN 7 THEN event_date || '-01'
      ELSE event_date END AS DATE) IS NOT NULL)
    UNION ALL SELECT id, event_date, false
    FROM alerts
    WHERE event_date IS NULL OR try_cast(CASE length(event_date) WHEN 4 THEN event_date || '-01-01' WHEN 7
      THEN event_date || '-01' ELSE event_date END AS DATE) IS NULL""")
def f06(t):
    return t.alerts.select("id", "event_date", dates.is_current(F.col("event_date"), F.expr(NOW), 6).alias("current_event"))


@query("F07_table_search", """SELECT id, name
    FROM assets
    WHERE fs_type = 'Product' AND (contains(lower(name), 'small') OR contains(lower(coalesce(category, '')), 'small')
      OR contains(lower(coalesce(lifecycle, '')), 'small'))""")
def f07(t):
    return t.assets.filter(p.table_search("SMALL", "Product", ["name", "category", "lifecycle"], "fs_type")).select("id", "name")


@query("F08_questions", "SELECT conv_id, turn, regexp_matches(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), '(^| )(" + "|".join(p.QUESTION_WORDS) + ")( |$)') AS question FROM conversations")
def f08(t):
    return t.conversations.select("conv_id", "turn", p.is_question(F.col("text")).alias("question"))


@query("F09_drop_malformed", """SELECT e.source_id, e.target_id, e.rel
    FROM topic_edges e
    JOIN topics t ON t.id = e.target_id - 1000000
    WHERE e.source_id <> e.target_id AND e.rel <> 'is_part_of' AND t.name <> ''""")
def f09(t):
    edges = t.topic_edges.withColumn("rel", repair.relation(F.when(F.col("rel") == "depends_on", "Requires  Approval by").when(F.col("rel") == "is_part_of", "replaces").otherwise(F.col("rel"))))
    known = t.topics.filter("name <> ''").select((F.col("id") + 1000000).alias("target_id"))
    return edges.filter("source_id <> target_id AND rel IS NOT NULL").join(known, "target_id", "left_semi").select("source_id", "target_id", "rel")


@query("X01_fold", """SELECT doc_id, replace(replace(replace(translate(strip_accents(text), 'øđðłħı', 'oddlhi'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS folded
    FROM documents
    WHERE lang IN ('de', 'fr', 'es')""")
def x01(t):
    return t.documents.filter(F.col("lang").isin("de", "fr", "es")).select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("X02_topic_key", """SELECT id, name || '-Standard Deviation' AS display,
      trim(regexp_replace(lower(replace(name, '_', ' ')), '[^a-z0-9]+', ' ', 'g')) || ' standard deviation' AS topic_key
    FROM topics""")
def x02(t):
    """Underscores, runs of spaces, dashes, parentheses and a closing word, around names of which only the spaces differ."""
    said = F.concat(F.lit("  "), F.col("name"), F.lit("\u2013Standard__Deviation \t Guidelines "))
    held = F.concat(F.col("name"), F.lit(" (old) Stand\u00e1rd-Deviation PROCESS"))
    return t.topics.select("id", text.topic_name(said).alias("display"), text.topic_key(held).alias("topic_key"))


@query("X03_duplicate_key", "SELECT doc_id, trim(regexp_replace(lower(replace(strip_accents(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words_key FROM documents")
def x03(t):
    return t.documents.select("doc_id", text.words_key(F.col("text")).alias("words_key"))


@query("X04_taxonomy_key", "SELECT p_partkey, trim(regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS taxonomy_key FROM part")
def x04(t):
    return t.part.select("p_partkey", text.words_key(F.concat_ws(" & ", "p_type", "p_brand")).alias("taxonomy_key"))


@query("X05_labels", """SELECT id, CASE lifecycle WHEN 'plan' THEN 'Plan' WHEN 'phaseIn' THEN 'Phase in' WHEN 'active' THEN 'Active' WHEN 'phaseOut' THEN 'Phase out' WHEN 'endOfLife' THEN 'End of life' ELSE 'Not set' END AS lifecycle_label,
CASE criticality WHEN 'missionCritical' THEN 'Mission critical' WHEN 'businessCritical' THEN 'Business critical' WHEN 'businessOperational' THEN 'Business operational' ELSE 'Not set' END AS criticality_label FROM assets""")
def x05(t):
    return t.assets.select("id", text.label(F.col("lifecycle")).alias("lifecycle_label"), text.label(F.col("criticality")).alias("criticality_label"))


REACH = "SELECT from_id, count(DISTINCT to_id) AS reach FROM relations WHERE rel = 'serves' GROUP BY from_id"


def reach_of(t):
    return t.relations.filter("rel = 'serves'").groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("reach"))


@query("X06_research_priority", f"""SELECT id, coalesce(reach, 0) + CASE criticality WHEN 'missionCritical' THEN 30 WHEN 'businessCritical' THEN 20 WHEN 'businessOperational' THEN 10 ELSE 0 END AS priority
    FROM assets
    LEFT
    JOIN ({REACH}) r ON r.from_id = id""")
def x06(t):
    return t.assets.join(reach_of(t), "id", "left").select("id", dates.research_priority(F.col("reach"), F.col("criticality")).alias("priority"))


@query("X07_keyword_probe", """SELECT id, CASE WHEN NOT contains(lower(name), lower(split_part(description, ' ', 1))) OR NOT contains(lower(name),
      lower(split_part(description, ' ', 2))) THEN array_to_string(string_split(description, ' '), ' ') END AS probe
    FROM topics""")
def x07(t):
    return t.topics.select("id", repair.keyword_probe(F.col("name"), F.split("description", " ")).alias("probe"))


@query("X08_coarse_date", """SELECT id, CASE WHEN try_cast(CASE length(event_date) WHEN 4 THEN event_date || '-01-01' WHEN 7 THEN event_date || '-01' ELSE event_date END AS DATE) IS NOT NULL THEN event_date END AS coarse
    FROM alerts""")
def x08(t):
    return t.alerts.select("id", dates.coarse_date(F.col("event_date")).alias("coarse"))


@query("X09_widened_date", f"""SELECT id, CAST({WIDE} AS STRING) AS last_day
    FROM (SELECT id, CASE WHEN try_cast(CASE length(event_date) WHEN 4 THEN event_date || '-01-01' WHEN 7 THEN event_date || '-01' ELSE event_date END AS DATE) IS NOT NULL THEN event_date END AS d
    FROM alerts)""")
def x09(t):
    return t.alerts.select("id", dates.widened(F.col("event_date")).cast("string").alias("last_day"))


@query("X10_cutoff", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS STRING) AS cutoff FROM orders")
def x10(t):
    return t.orders.select("o_orderkey", dates.cutoff(F.col("o_orderdate").cast("date"), 6).cast("string").alias("cutoff"))


PHASES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'not json' ELSE '[{"phase":"phaseOut","startDate":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"},{"phase":"endOfLife","startDate":"' || CASE WHEN o_orderkey % 3 = 0 THEN '1999' ELSE '1998-06-30' END || '"}]' END AS raw,
  CASE WHEN o_orderkey % 5 = 0 THEN DATE '1997-01-01' END AS end_date FROM orders"""


def phases(column):
    """Phases of a JSON list that have a full date; an unusable text is an empty list."""
    found = F.from_json(column, "array<struct<phase:string,startDate:string>>")
    good = F.filter(found, lambda x: F.try_to_date(F.when(x["startDate"].rlike(r"^\d{4}-\d{2}-\d{2}$"), x["startDate"]), "yyyy-MM-dd").isNotNull())
    return F.coalesce(good, F.array().cast("array<struct<phase:string,startDate:string>>"))


@query("X11_lifecycle_phases", f"""SELECT id, CAST(CASE WHEN id % 7 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_phases,
      CASE WHEN id % 7 <> 0 THEN 'phaseOut' END AS first_phase
    FROM ({PHASES})""")
def x11(t):
    rows = t.spark.sql(PHASES.replace("FROM orders", "FROM {orders}").replace('{"', '{{"').replace('"}', '"}}'), orders=t.orders)
    return rows.select("id", F.size(phases(F.col("raw"))).cast("long").alias("n_phases"), F.get(phases(F.col("raw")), F.lit(0))["phase"].alias("first_phase"))


@query("X12_earliest_ending", f"""SELECT id, CAST(d.end_on AS STRING) AS end_on, d.kind AS kind FROM (SELECT id, list_sort([x FOR x IN [struct_pack(end_on := CASE WHEN id % 7 <> 0 THEN CAST(regexp_extract(raw, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS DATE) END, rank := 0, kind := 'phaseOut'),
 struct_pack(end_on := CASE WHEN id % 7 <> 0 AND id % 3 <> 0 THEN DATE '1998-06-30' END, rank := 1, kind := 'endOfLife'), struct_pack(end_on := end_date, rank := 2, kind := 'column')] IF x.end_on IS NOT NULL])[1] AS d FROM ({PHASES}))""")
def x12(t):
    rows = t.spark.sql(PHASES.replace("FROM orders", "FROM {orders}").replace('{"', '{{"').replace('"}', '"}}'), orders=t.orders)
    ends = F.transform(F.filter(phases(F.col("raw")), lambda x: x["phase"].isin("phaseOut", "endOfLife")), lambda x: F.struct(x["startDate"].cast("date").alias("end_on"), F.when(x["phase"] == "phaseOut", 0).otherwise(1).alias("rank"), x["phase"].alias("kind")))
    own = F.when(F.col("end_date").isNotNull(), F.array(F.struct(F.col("end_date").alias("end_on"), F.lit(2).alias("rank"), F.lit("column").alias("kind")))).otherwise(F.array().cast("array<struct<end_on:date,rank:int,kind:string>>"))
    first = F.array_min(F.concat(ends, own))
    return rows.select("id", first["end_on"].cast("string").alias("end_on"), first["kind"].alias("kind"))


@query("X13_months_away", f"SELECT id, round(date_diff('day', {NOW}, end_date) / 30.44, 6) AS months, end_date < {NOW} AS started FROM assets WHERE end_date IS NOT NULL")
def x13(t):
    away = dates.months_away(F.col("end_date"), F.expr(NOW))
    return t.assets.filter("end_date IS NOT NULL").select("id", F.round(away, 6).alias("months"), (away < 0).alias("started"))


@query("X14_exposure", """SELECT id, round(CASE severity WHEN 'critical' THEN 1000 WHEN 'high' THEN 300 WHEN 'medium' THEN 60 WHEN 'low' THEN 10 ELSE 1 END * (1 + log10(1 + greatest(0, id % 50 - 3))), 6) AS exposure
    FROM alerts""")
def x14(t):
    return t.alerts.select("id", F.round(dates.exposure(F.col("severity"), F.col("id") % 50 - 3), 6).alias("exposure"))


@query("X15_severity_rank", "SELECT id, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank FROM alerts")
def x15(t):
    return t.alerts.select("id", dates.severity_rank(F.col("severity")).alias("rank"))


@query("X16_hashes", """SELECT l_orderkey, sha256(string_agg(CAST(l_partkey AS STRING), ','
    ORDER BY l_partkey) || ':' || CAST(count(*) AS STRING)) AS members
    FROM lineitem
    GROUP BY l_orderkey""")
def x16(t):
    return t.lineitem.groupBy("l_orderkey").agg(text.members_hash(F.collect_list("l_partkey")).alias("members"))


@query("X17_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def x17(t):
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("X18_local_buckets", """SELECT id, CAST(to_timestamp(floor((epoch(date_trunc('second', created_at)) - 28800) / 21600) * 21600 + 28800) AT TIME ZONE 'UTC' AS STRING) AS bucket
    FROM usage_log""")
def x18(t):
    return t.usage_log.select("id", dates.bucket_start(F.col("created_at"), 6, -480).cast("string").alias("bucket"))


@query("X19_json_or", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INT) END AS k FROM events")
def x19(t):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(repair.json_or(raw, "k int", F.lit(None))["k"], F.lit(-1)).alias("k"))


@query("X20_tags", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brand: ' ELSE '' END || p_brand || ', type: ' || p_type AS tags FROM part")
def x20(t):
    tag = lambda g, n: F.struct(g.alias("group"), n.alias("name"))
    return t.part.select("p_partkey", repair.tags(F.array(tag(F.when(F.col("p_size") % 2 == 0, "brand"), F.col("p_brand")), tag(F.lit("type"), F.col("p_type")))).alias("tags"))


@query("X21_text_to_embed", "SELECT id, name || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS to_embed FROM topics")
def x21(t):
    return t.topics.select("id", F.concat_ws(": ", "name", text.blank_to_null(F.col("description"))).alias("to_embed"))


@query("X22_distinct_labels", """SELECT o_orderkey, string_agg(p, ','
    ORDER BY i) AS labels
    FROM (SELECT o_orderkey, p, min(i) AS i
    FROM (SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus, o_orderpriority, '']) AS p, unnest([1, 2, 3, 4]) AS i
    FROM orders)
    WHERE p <> ''
    GROUP BY ALL)
    GROUP BY o_orderkey""")
def x22(t):
    s = lambda c: F.struct(c.alias("label"))
    values = F.array(s(F.col("o_orderpriority")), s(F.col("o_orderstatus")), s(F.col("o_orderpriority")), s(F.lit("")))
    return t.orders.select("o_orderkey", F.array_join(F.transform(repair.distinct_by_label(values, "label"), lambda x: x["label"]), ",").alias("labels"))


@query("X23_ranking", """SELECT l_orderkey, l_linenumber, list_distinct_order AS ranking
    FROM (SELECT l_orderkey, l_linenumber,
      CASE WHEN l_quantity % 8 = l_linenumber THEN [l_linenumber] ELSE [l_linenumber, CAST(l_quantity % 8 AS INT)] END AS h,
      h || [x FOR x IN range(0, 8) IF NOT list_contains(h, x)] AS list_distinct_order
    FROM lineitem)""")
def x23(t):
    values = F.array(F.col("l_linenumber") + F.lit(0.4), F.col("l_quantity") % 8, F.lit(99.0), F.lit(float("nan")), F.lit(-3.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.transform(repair.ranking(values, F.lit(8)), lambda x: x.cast("long")).alias("ranking"))


@query("X24_verdicts", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'update' WHEN event_type = 'click' THEN 'conflict' ELSE 'consistent' END AS status,
      CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN CAST(event_id % 4 AS INT) END AS supersedes
    FROM events""")
def x24(t):
    status = F.when(F.col("event_type") == "view", "update").when(F.col("event_type") == "click", "conflict").otherwise(F.col("event_type"))
    index = F.when(F.col("event_id") % 4 == 0, F.lit("-1")).otherwise((F.col("event_id") % 4).cast("string"))
    v = repair.verdict(status, index)
    return t.events.select("event_id", v["status"].alias("status"), v["supersedes"].alias("supersedes"))


@query("X25_keywords", "SELECT p_partkey, list_filter(string_split(p_name || ' a  x', ' '), lambda w: length(w) > 1)[:8] AS keywords FROM part")
def x25(t):
    return t.part.select("p_partkey", repair.keywords(F.split(F.concat("p_name", F.lit(" a  x")), " ")).alias("keywords"))


@query("X26_assessments", """SELECT event_id, event_type <> 'error' AS identified,
      CASE event_type WHEN 'view' THEN 'solid' WHEN 'click' THEN 'replace' ELSE 'unknown' END AS verdict,
      CASE WHEN event_type = 'error' THEN 0 ELSE round(least(1, greatest(0, value / 50 - 0.1)), 6) END AS confidence,
      CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS n_strengths
    FROM events""")
def x26(t):
    v = F.when(F.col("event_type") == "view", "solid").when(F.col("event_type") == "click", "replace").otherwise(F.col("event_type"))
    a = repair.assessment(F.col("event_type") != "error", v, F.col("value") / 50 - 0.1, F.array(F.lit(" a "), F.lit(" "), F.lit("b")), F.array().cast("array<string>"))
    return t.events.select("event_id", a["identified"].alias("identified"), a["verdict"].alias("verdict"), F.round(a["confidence"], 6).alias("confidence"), F.size(a["strengths"]).alias("n_strengths"))


@query("X27_relations", """SELECT rel, count(*) AS n
    FROM (SELECT CASE rel WHEN 'is_part_of' THEN 'is_a' WHEN 'depends_on' THEN 'manages' END AS rel
    FROM topic_edges)
    GROUP BY rel""")
def x27(t):
    said = F.when(F.col("rel") == "is_part_of", " Is A").when(F.col("rel") == "depends_on", "responsible FOR").otherwise("replaces")
    return t.topic_edges.groupBy(repair.relation(said).alias("rel")).agg(F.count("*").alias("n"))
