"""Queries of ingestion (C) and of the fact store (K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstead import sources as s
from loomstead.functions.text import fingerprint, topic_key
from loomstead.operators import facts as k
from loomstead.operators.relational import page
from loomstead.plans.registry import query
from loomstead.sources.keyed import KeyedTable
from loomstead.storage import shared_dir


def nodes(t):
    """Nested records of parts: phases, far ends and people."""
    phases = F.array(F.struct(F.lit("active").alias("phase"), F.lit("1999-01-01").alias("startDate")), F.struct(F.lit("endOfLife").alias("phase"), F.when(F.col("p_size") % 2 == 0, F.lit(" 2024-06-30 ")).alias("startDate")))
    far = lambda c: F.array(F.struct(c.alias("id"), c.alias("name")))
    people = F.array(F.struct(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 3 > 0, F.array(F.lit("owner"), F.lit("owner"))).alias("roles")))
    desc = F.when(F.col("p_size") % 4 == 0, F.lit("  ")).otherwise(F.col("p_type"))
    return t.part.select(F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.lit("Product").alias("type"), desc.alias("description"), F.struct(phases.alias("phases")).alias("lifecycle"), far(F.col("p_brand")).alias("vendor"), far(F.when(F.col("p_size") % 7 > 0, F.col("p_type"))).alias("capability"), people.alias("people")).alias("node"))


@query("C02_text_files", "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 4 < 2")
def c02(t):
    """Files of the documents' ids and hashes in four folders, written first: two that are read, an ignored one, and the one for
    cleaned copies; then read below their common folder."""
    folder = f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"
    rows = t.documents.filter("text IS NOT NULL").select("doc_id", F.concat_ws(" ", "doc_id", F.sha2("text", 256)).alias("value"))
    for place, name in enumerate(("notes", "notes/deep/er", "notes/!drafts", "cleaned")):
        rows.filter(F.pmod("doc_id", F.lit(4)) == place).select("value").write.mode("append").text(f"{folder}/{name}")
    lines = s.text_files(t.spark, folder, ["TXT"]).select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.split_part("line", F.lit(" "), F.lit(1)).cast("long").alias("doc_id"), F.split_part("line", F.lit(" "), F.lit(2)).alias("h"))


@query("C03_flat_records", """SELECT 'P' || CAST(p_partkey AS STRING) AS id, p_name AS name, 'Product' AS type, CASE WHEN p_size % 4 <> 0 THEN p_type END AS description,
      2 AS n_phases, CASE WHEN p_size % 2 = 0 THEN '2024-06-30' END AS end_date
    FROM part""")
def c03(t):
    return nodes(t).select(*s.flat_asset("node"))


@query("C04_relation_rows", "SELECT from_id, rel, to_id, to_name FROM relations WHERE rel IN ('vendor', 'capability')")
def c04(t):
    return s.relation_rows(nodes(t), "node", ["vendor", "capability"])


@query("C05_role_rows", "SELECT 'P' || CAST(p_partkey AS STRING) AS id, p_brand AS person, CASE WHEN p_size % 3 > 0 THEN 'owner' END AS role FROM part")
def c05(t):
    return s.role_rows(nodes(t), "node")


@query("C06_taxonomy_rows", """SELECT r_name AS l1, n_name AS l2, c_mktsegment AS l3, CAST(max(c_custkey) AS STRING) AS ref
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    WHERE n_regionkey <> 1
    GROUP BY 1, 2, 3
    UNION ALL SELECT r_name, NULL, NULL, NULL
    FROM region
    WHERE r_regionkey = 1""")
def c06(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    blank = F.when(F.col("n_regionkey") == 1, F.lit(" n/a "))
    return s.taxonomy_rows(rows.select(F.col("c_custkey").alias("row_no"), F.col("r_name").alias("l1"), F.coalesce(blank, "n_name").alias("l2"), F.col("c_mktsegment").alias("l3"), F.col("c_custkey").cast("string").alias("ref")), ["n/a", "-"])


@query("C07_snapshot_changes", """SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN sha256(o.content) = sha256(n.content) THEN 'unchanged' ELSE 'changed' END AS change
    FROM snapshot_old o
    FULL
    JOIN snapshot_new n ON n.id = o.id""")
def c07(t):
    return s.changes(t.snapshot_old, t.snapshot_new, "id", "content")


@query("C08_change_probe", "SELECT false AS same")
def c08(t):
    return s.same_rows(t.snapshot_old, t.snapshot_new, ["id", "path"])


@query("C09_empty_snapshot", "SELECT id, 'removed' AS change FROM snapshot_old WHERE false")
def c09(t):
    return s.changes(t.snapshot_old, t.snapshot_new.filter("id < 0"), "id", "content")


@query("C10_replace_children", """SELECT l_orderkey, l_linenumber, l_quantity
    FROM lineitem
    WHERE l_orderkey % 9 <> 0
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1
    FROM lineitem
    WHERE l_orderkey % 9 = 0""")
def c10(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    new = rows.filter("l_orderkey % 9 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    return s.replace_children(rows, new, new, "l_orderkey")


@query("C10_replace_in_runs", """SELECT l_orderkey, l_linenumber, l_quantity
    FROM lineitem
    WHERE l_orderkey % 9 NOT IN (0, 5)
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1
    FROM lineitem
    WHERE l_orderkey % 9 = 0""")
def c10b(t):
    """Children in a table between runs: the first run stores all, the second replaces those of some parents and takes others away."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    table = KeyedTable.create(t.spark, f"{shared_dir(t.spark)}/children-{uuid.uuid4().hex}", "l_orderkey long, l_linenumber int, l_quantity double", ["l_orderkey"])
    cast = lambda df: df.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "l_quantity")
    table.apply(0, cast(rows), lambda old: cast(rows))
    keys = cast(rows).filter("l_orderkey % 9 IN (0, 5)").select("l_orderkey")
    new = cast(rows).filter("l_orderkey % 9 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    table.apply(1, new, lambda old: s.replace_children(old, new, keys, "l_orderkey"), keys)
    return table.read()


RENDER = """SELECT a.id, concat_ws(chr(10), '# ' || name, 'Type: ' || fs_type, 'Lifecycle: ' || lifecycle, r.relations) AS text FROM assets a LEFT JOIN (SELECT from_id, string_agg(rel || ': ' || names, chr(10) ORDER BY rel || ': ' || names) AS relations FROM
(SELECT from_id, rel, CASE WHEN len(l) > 12 THEN CAST(len(l) AS STRING) || ' in total, including ' || array_to_string(l[:12], ', ') || ' (and ' || CAST(len(l) - 12 AS STRING) || ' more)' ELSE array_to_string(l, ', ') END AS names FROM (SELECT from_id, rel, list_sort(list(DISTINCT to_name)) AS l FROM relations GROUP BY 1, 2)) GROUP BY from_id) r ON r.from_id = a.id"""


@query("C11_rendered_documents", RENDER)
def c11(t):
    return s.rendered(t.assets, t.relations)


@query("C12_summaries", """SELECT from_id AS id, CAST(count(DISTINCT to_id) AS STRING) || ' links, among them ' || array_to_string(list_sort(list(DISTINCT to_name))[:6],
      ', ') AS summary
    FROM relations
    GROUP BY from_id""")
def c12(t):
    first = F.array_join(F.slice(F.sort_array(F.collect_set("to_name")), 1, 6), ", ")
    return t.relations.groupBy(F.col("from_id").alias("id")).agg(F.concat(F.count_distinct("to_id").cast("string"), F.lit(" links, among them "), first).alias("summary"))


@query("C13_render_gate", f"""SELECT id, CASE WHEN id IN (SELECT from_id
    FROM relations
    WHERE rel = 'capability' AND to_id = 'ECONOMY') THEN 'changed' ELSE 'unchanged' END AS change
    FROM ({RENDER})""")
def c13(t):
    new = t.relations.withColumn("to_name", F.when(F.col("to_id") == "ECONOMY", "Economy").otherwise(F.col("to_name")))
    return s.changes(s.rendered(t.assets, t.relations), s.rendered(t.assets.withColumn("completion", F.lit(0.0)), new), "id", "text")


@query("C14_identity", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'source' WHEN lang <> 'de' THEN 'repo' END AS kind FROM documents")
def c14(t):
    en = F.col("lang") == "en"
    key = s.identity(F.when(en, F.col("source")), F.when(en, F.col("doc_id").cast("string")), F.when(F.col("lang") != "de", F.lit("r")), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", key["kind"].alias("kind"))


@query("C15_required_rows", "SELECT o.id, CASE WHEN o.id % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM snapshot_old o")
def c15(t):
    return s.changes(t.snapshot_old, t.snapshot_old, "id", "content", t.snapshot_old.filter("id % 4 <> 0"))


@query("C16_document_list", """SELECT d.doc_id, d.source, n_name AS repo
    FROM documents d
    LEFT
    JOIN nation ON 'src' || CAST(n_nationkey AS STRING) = d.source
    ORDER BY d.doc_id DESC LIMIT 100""")
def c16(t):
    repos = t.nation.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"), F.col("n_name").alias("repo"))
    return t.documents.select("doc_id", "source").join(repos, "source", "left").orderBy(F.desc("doc_id")).limit(100).select("doc_id", "source", "repo")


@query("K01_merge_topics", """SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, min(id) AS id, arg_min(name, id) AS name, arg_max(description,
      length(description) * 1000000000 - id) AS description, arg_min(category, id) FILTER (WHERE category IS NOT NULL) AS category
    FROM topics
    GROUP BY 1""")
def k01(t):
    return k.merge_topics(t.topics.select("id", "name", "description", "category"))


@query("K02_resolve_names", "SELECT p_partkey, min(o.id) AS topic_id FROM part JOIN topics o ON o.name = p_name GROUP BY p_partkey")
def k02(t):
    asked = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("name"))
    return k.resolve_names(asked, t.topics.select("id", "name")).select("p_partkey", "topic_id")


@query("K03_claims", """SELECT sha256(claim_text) AS claim_hash, min(id) AS claim_id, arg_min(topic_id, id) AS topic_id, arg_min(doc_id, id) AS doc_id,
      min(claim_text) AS claim_text, arg_min(status, id) AS status
    FROM claims
    GROUP BY 1""")
def k03(t):
    return k.insert_claims(t.claims)[0]


@query("K03_support", """SELECT h.claim_id, c.doc_id, min(c.id) AS first_id
    FROM claims c
    JOIN (SELECT claim_text, min(id) AS claim_id
    FROM claims
    GROUP BY 1) h ON h.claim_text = c.claim_text
    GROUP BY 1, 2""")
def k03b(t):
    return k.insert_claims(t.claims)[1]


@query("K04_near_duplicates", "SELECT min(id) AS id, topic_id FROM claims GROUP BY topic_id, claim_text")
def k04(t):
    rows = t.claims.select("id", "topic_id", F.when(F.col("id") % 2 == 0, F.upper("claim_text")).otherwise(F.concat("claim_text", F.lit("!"))).alias("claim_text"))
    return k.drop_near_duplicates(rows, ["topic_id"], "claim_text", "id").select("id", "topic_id")


@query("K05_verdicts", """SELECT id, CASE WHEN id % 7 = 0 THEN 'skipped' WHEN id % 5 = 0 THEN 'flagged' WHEN id % 3 = 0 THEN 'conflicted' ELSE 'active' END AS status,
      CASE WHEN id % 7 <> 0 AND id % 5 <> 0 AND id % 3 <> 0 AND row_number() OVER (PARTITION BY CASE WHEN id % 7 <> 0
      AND id % 3 <> 0 THEN topic_id END
    ORDER BY id) = 1 THEN topic_id END AS retires
    FROM claims""")
def k05(t):
    v = F.when(F.col("id") % 7 == 0, "duplicate").when(F.col("id") % 3 == 0, "conflict").otherwise("update")
    verdicts = t.claims.select("id", v.alias("verdict"), F.when(v == "update", F.col("topic_id")).alias("supersedes"), (F.col("id") % 5 != 0).alias("aligned"))
    return k.apply_verdicts(t.claims.select("id"), verdicts, t.lineitem.count())


SUPPORT = """SELECT h.claim_id, c.doc_id
    FROM claims c
    JOIN (SELECT claim_text, min(id) AS claim_id
    FROM claims
    GROUP BY 1) h ON h.claim_text = c.claim_text
    GROUP BY 1, 2"""


@query("K06_reattribute", f"""SELECT c.claim_id, CASE WHEN c.doc_id % 2 = 0 THEN h.heir ELSE c.doc_id END AS doc_id
    FROM (SELECT min(id) AS claim_id, arg_min(doc_id, id) AS doc_id
    FROM claims
    GROUP BY claim_text) c
    LEFT
    JOIN (SELECT claim_id, min(doc_id) AS heir
    FROM ({SUPPORT})
    WHERE doc_id % 2 <> 0
    GROUP BY 1) h ON h.claim_id = c.claim_id
    WHERE c.doc_id % 2 <> 0 OR h.heir IS NOT NULL""")
def k06(t):
    claims, support = k.insert_claims(t.claims)
    removed = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("doc_id"))
    return k.reattribute(claims.select("claim_id", "doc_id"), support, removed).select("claim_id", "doc_id")


@query("K07_cascade", f"SELECT claim_id, doc_id FROM ({SUPPORT}) WHERE doc_id % 2 <> 0")
def k07(t):
    removed = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("doc_id"))
    return k.insert_claims(t.claims)[1].join(removed, "doc_id", "left_anti").select("claim_id", "doc_id")


@query("K08_sweep_orphans", """SELECT source_id, target_id, rel
    FROM topic_edges
    WHERE target_id - 1000000 IN (SELECT id
    FROM topics
    WHERE id IN (SELECT topic_id
    FROM claims
    WHERE status = 'superseded') OR category IS NOT NULL)""")
def k08(t):
    linked = t.topics.filter("category IS NOT NULL").select("id")
    gone = k.orphans(t.topics.select("id"), t.claims.filter("status = 'superseded'"), linked)
    return t.topic_edges.join(gone.select((F.col("id") + 1000000).alias("target_id")), "target_id", "left_anti").select("source_id", "target_id", "rel")


@query("K09_review", """SELECT id, CASE id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'deleted' ELSE CASE WHEN status = 'superseded' THEN 'active' ELSE 'invalid' END END AS outcome
    FROM claims
    WHERE status <> 'active'""")
def k09(t):
    d = F.when(F.col("id") % 4 == 0, "accept").when(F.col("id") % 4 == 1, "dismiss").when(F.col("id") % 4 == 2, "reject").otherwise("restore")
    decisions = t.claims.filter("status <> 'active'").select("id", d.alias("decision"))
    return k.review(t.claims.select("id", "status"), decisions).select("id", "outcome")


@query("K10_topic_history", """SELECT a.id, a.status, b.claim_text AS successor
    FROM claims a
    LEFT
    JOIN claims b ON b.id = a.superseded_by
    WHERE a.topic_id = 7
    ORDER BY a.created_at DESC, a.id LIMIT 20""")
def k10(t):
    after = t.claims.select(F.col("id").alias("superseded_by"), F.col("claim_text").alias("successor"))
    rows = t.claims.filter("topic_id = 7").join(after, "superseded_by", "left")
    return page(rows, [F.desc("created_at"), F.col("id")]).select("id", "status", "successor")


@query("K11_reset_scope", f"SELECT count(*) AS claims_left FROM (SELECT DISTINCT claim_id FROM ({SUPPORT}) WHERE doc_id <> 3)")
def k11(t):
    claims, support = k.insert_claims(t.claims)
    removed = t.supplier.filter("s_suppkey = 3").select(F.col("s_suppkey").alias("doc_id"))
    return k.reattribute(claims.select("claim_id", "doc_id"), support, removed).agg(F.count("*").alias("claims_left"))


K12 = """SELECT asset_id, title, CAST(coalesce(min(seen_at) FILTER (WHERE id % 2 = 0), min(seen_at)) AS STRING) AS first_seen,
      CAST(max(seen_at) AS STRING) AS last_seen
    FROM alerts
    WHERE id % 2 = 1 OR asset_id LIKE '%1' OR true
    GROUP BY asset_id, title
    HAVING count(*) FILTER (WHERE id % 2 = 1) > 0 OR asset_id NOT IN (SELECT asset_id
    FROM alerts
    WHERE id % 2 = 1 AND asset_id LIKE '%1')"""


@query("K12_alert_reconcile", K12)
def k12(t):
    keyed = t.alerts.select("id", "asset_id", "title", F.concat_ws("|", "category", "title").alias("fingerprint"), "seen_at")
    stored = keyed.filter("id % 2 = 0").groupBy("asset_id", "fingerprint").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    new = keyed.filter("id % 2 = 1")
    refreshed = new.filter("asset_id LIKE '%1'").select("asset_id")
    late = new.withColumn("seen_at", F.greatest("seen_at", F.lit("1970-01-01").cast("timestamp_ntz")))
    out = k.reconcile_alerts(stored, late, refreshed)
    first = stored.select("asset_id", "fingerprint", F.col("first_seen").alias("f_"))
    out = out.join(first, ["asset_id", "fingerprint"], "left")
    return out.select("asset_id", F.split_part("fingerprint", F.lit("|"), F.lit(2)).alias("title"), F.coalesce("f_", "first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


@query("K12_reconcile_in_runs", K12)
def k12b(t):
    """The stored alerts as a table that one run fills and the next one reconciles; each run is applied twice, and counts once."""
    keyed = t.alerts.select("id", "asset_id", F.concat_ws("|", "category", "title").alias("fingerprint"), F.col("seen_at").cast("timestamp").alias("seen_at"))
    schema = "asset_id string, fingerprint string, first_seen timestamp, last_seen timestamp"
    table = KeyedTable.create(t.spark, f"{shared_dir(t.spark)}/alerts-{uuid.uuid4().hex}", schema, ["asset_id"])
    for run in (0, 1):
        new = keyed.filter(F.col("id") % 2 == run)
        refreshed = new.filter("asset_id LIKE '%1'").select("asset_id") if run else new.limit(0).select("asset_id")
        for _ in range(2):
            table.apply(run, new, lambda old, new=new, refreshed=refreshed: k.reconcile_alerts(old, new, refreshed))
    first = keyed.filter("id % 2 = 0").groupBy("asset_id", "fingerprint").agg(F.min("seen_at").alias("f_"))
    out = table.read().join(first.hint("merge"), ["asset_id", "fingerprint"], "left")
    return out.select("asset_id", F.split_part("fingerprint", F.lit("|"), F.lit(2)).alias("title"), F.coalesce("f_", "first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


DUE = """SELECT p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 4 END AS researched_days, p_size % 7 = 0 AS hash_changed,
      p_size % 5 = 0 AS had_error, p_size % 2 = 0 AS identified, p_size % 11 = 0 AS forced, p_partkey % 13 AS priority
    FROM part"""


@query("K13_refresh_due", f"""SELECT id, reason, row_number() OVER (ORDER BY list_position(['new', 'changed', 'errored', 'stale', 'forced'], reason), priority DESC,
      researched_days DESC NULLS FIRST, id) > 60 AS deferred
    FROM (SELECT *, CASE WHEN researched_days IS NULL THEN 'new' WHEN hash_changed THEN 'changed' WHEN had_error THEN 'errored' WHEN researched_days > CASE WHEN identified THEN 90 ELSE 30 END THEN 'stale' WHEN forced THEN 'forced' END AS reason
    FROM ({DUE}))
    WHERE reason IS NOT NULL""")
def k13(t):
    return k.refresh_due(t.spark.sql(DUE.replace("FROM part", "FROM {part}"), part=t.part), 60).select("id", "reason", "deferred")


@query("K14_failed_extractions", "SELECT source, count(*) AS n_failed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def k14(t):
    done = t.labels.select("doc_id").withColumn("done", F.lit(True))
    rows = t.documents.select("doc_id", "source").join(done, "doc_id", "left")
    return rows.filter(F.col("done").isNull()).groupBy("source").agg(F.count("*").alias("n_failed"))
