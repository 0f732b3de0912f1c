"""Queries of text (T), vectors (V), retrieval (R) and their measurement (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstead.functions.text import blank_to_null, topic_key
from loomstead.operators import corpus as c
from loomstead.operators import impacts
from loomstead.operators import retrieval as r
from loomstead.operators import vectors as v
from loomstead.operators.facts import aligned
from loomstead.plans.registry import INPUTS, query

INPUTS["asked"] = "SELECT p_partkey AS qid, p_name AS query FROM part WHERE p_partkey % 50 = 0"
INPUTS["texts"] = "SELECT p_partkey AS doc_id, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_name AS text FROM part"
TOKENS = "list_filter(string_split_regex(regexp_replace(lower(replace(strip_accents(text), 'ß', 'ss')), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3)"
INPUTS["queries_vec"] = "SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0"


@query("T01_chunks")
def t01(t):
    return c.chunks(t.documents, "doc_id", "text")


@query("T02_supplied_chunks")
def t02(t):
    """Two sections a document, half by half; every second document has chunks supplied, every fourth too little of them."""
    half = F.ceil(F.length("text") / 2).cast("int")
    cuts = F.array(F.struct(F.lit(0).alias("section"), F.substring("text", F.lit(1), half).alias("body")), F.struct(F.lit(1).alias("section"), F.substring("text", half + 1, F.length("text")).alias("body")))
    sections = t.documents.filter("text IS NOT NULL").select("doc_id", F.explode(cuts).alias("s")).select("doc_id", "s.section", "s.body")
    content = F.when(F.col("doc_id") % 4 == 0, F.substring("body", F.lit(1), (F.length("body") / 2).cast("int"))).otherwise(F.col("body"))
    supplied = sections.filter("doc_id % 2 = 0").select("doc_id", "section", F.lit(0).alias("chunk_no"), content.alias("content"))
    return c.supplied_or_cut(sections, supplied, ["doc_id", "section"], "body")


@query("T03_cleaning_audit", """SELECT doc_id, length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS removed,
      round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[aeiou]', '', 'g')) / length(text) ELSE 1 END, 6) AS kept_share,
      CASE WHEN length(text) > 0 AND length(regexp_replace(text, '[aeiou]', '', 'g')) / length(text) < 0.5 THEN 'check' ELSE 'fine' END AS verdict
    FROM documents""")
def t03(t):
    cleaned = t.documents.select("doc_id", F.regexp_replace("text", "[aeiou]", "").alias("text"))
    return c.cleaning_audit(t.documents, cleaned, "doc_id", "text")


@query("T04_tokens", f"SELECT doc_id, len({TOKENS}) AS n_tokens FROM documents")
def t04(t):
    from loomstead.functions.text import fold, tokens

    return t.documents.select("doc_id", F.size(tokens(F.lower(fold(F.col("text"))))).cast("long").alias("n_tokens"))


INDEX = f"""SELECT token, doc_id, count(*) AS tf, max(n) AS length
    FROM (SELECT doc_id, unnest({TOKENS}) AS token, len({TOKENS}) AS n
    FROM documents)
    GROUP BY 1, 2"""


@query("T05_inverted_index", INDEX)
def t05(t):
    return c.inverted_index(t.documents, "doc_id", "text")


BM25 = f"""WITH idx AS (SELECT token, doc_id, count(*) AS tf, max(n) AS length FROM (SELECT doc_id, unnest({TOKENS}) AS token, len({TOKENS}) AS n FROM texts) GROUP BY 1, 2),
pre AS (SELECT DISTINCT qid, unnest({TOKENS.replace('text', 'query')}) AS prefix FROM asked),
hit AS (SELECT prefix, doc_id, sum(tf) AS tf, max(length) AS length FROM (SELECT DISTINCT prefix FROM pre) JOIN idx ON starts_with(token, prefix) GROUP BY 1, 2),
tot AS (SELECT count(*) AS n, avg(length) AS avg FROM (SELECT doc_id, max(length) AS length FROM idx GROUP BY 1)), df AS (SELECT prefix, count(*) AS df FROM hit GROUP BY 1),
sc AS (SELECT qid, doc_id, round(sum(ln(1 + (tot.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / tot.avg))), 6) AS score FROM pre JOIN hit USING (prefix) JOIN df USING (prefix) CROSS JOIN tot GROUP BY 1, 2),
rk AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def alike(t):
    return c.Alike(t.texts, t.asked, "doc_id", "text")


@query("T06_bm25", BM25 + " SELECT qid, doc_id, score, rank FROM rk WHERE rank <= 10")
def t06(t):
    return alike(t).best(10)


INPUTS["asked_documents"] = """SELECT doc_id AS qid, split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 5) || ' ' || split_part(text, ' ', 8) || ' ' || split_part(text, ' ', 13) AS query
    FROM documents
    WHERE doc_id % 50 = 0"""
OVER_DOCUMENTS = BM25.replace("WITH idx AS", "WITH idx AS MATERIALIZED").replace("FROM texts", "FROM documents").replace("FROM asked", "FROM asked_documents").replace(
    "JOIN idx ON starts_with(token, prefix)", "JOIN (SELECT DISTINCT token FROM idx) words ON starts_with(token, prefix) JOIN idx USING (token)")


@query("T06_bm25_documents", OVER_DOCUMENTS + " SELECT qid, doc_id, score, rank FROM rk WHERE rank <= 10")
def t06b(t):
    """Four words of every 50th document against all documents, whole texts: blocks of documents meet all queries, and of each a task
    hands on the best ten alone."""
    return impacts.best(impacts.index_of(t.documents, "doc_id", "text"), t.asked_documents, 10)


@query("T07_snippets")
def t07(t):
    rows = t.documents.filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", "text")
    return c.snippets(rows, "text", "the").select("doc_id", "snippet")


@query("T08_passage_search", BM25 + " SELECT doc_id, count(*) AS n_matches, min(rank) AS best FROM rk WHERE doc_id % 2 = 0 GROUP BY doc_id")
def t08(t):
    allowed = t.texts.filter("doc_id % 2 = 0").select("doc_id")
    return alike(t).matches().join(allowed.hint("merge"), "doc_id", "left_semi")


@query("T09_summaries", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given' ELSE left(text, 500) END AS summary FROM documents")
def t09(t):
    given = blank_to_null(F.when(F.col("doc_id") % 3 == 0, F.lit(" given ")).otherwise(" "))
    return t.documents.select("doc_id", F.coalesce(given, F.substring("text", 1, 500)).alias("summary"))


COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5)"
TOPK = f"""SELECT q.vec_id AS qid, e.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY {COS} DESC, e.vec_id) AS rank
    FROM embeddings e
    CROSS
    JOIN queries_vec q"""


def exact(t, k):
    return v.top_k(t.embeddings, t.queries_vec, "vec_id", "embedding", k)


@query("V01_exact_top_k", f"SELECT qid, rank, id FROM ({TOPK}) WHERE rank <= 10")
def v01(t):
    return exact(t, 10).select("qid", "rank", "id")


@query("D02_vector_scan", f"SELECT qid, id, rank FROM ({TOPK}) WHERE rank <= 20")
def d02(t):
    """The vector extension's table function as SQL users call it: nearest rows of a view, with their distances."""
    exact(t, 20).createOrReplaceTempView("vector_scan")
    return t.spark.sql("SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY 1 - score, id) AS rank FROM vector_scan").withColumn("rank", F.col("rank").cast("long"))


@query("V02_floor", f"SELECT qid, id FROM ({TOPK}) WHERE rank <= 10 AND score >= 0.25")
def v02(t):
    return exact(t, 10).filter("score >= 0.25").select("qid", "id")


@query("V03_dimensions", "SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def v03(t):
    return v.dimensions(t.embeddings, "embedding")


@query("V04_neighbour_graph", """SELECT a, b
    FROM (SELECT least(qid, id) AS a, greatest(qid, id) AS b
    FROM (SELECT x.vec_id AS qid, y.vec_id AS id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 5) AS s,
      row_number() OVER (PARTITION BY x.vec_id
    ORDER BY round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 5) DESC, y.vec_id) AS r
    FROM embeddings x
    JOIN embeddings y ON x.vec_id <> y.vec_id)
    WHERE r <= 5 AND s >= 0.2)
    GROUP BY 1, 2""")
def v04(t):
    """Through inverted lists, all of which are searched: the exact graph."""
    lists = v.Lists(t.embeddings, "vec_id", "embedding", 8)
    return v.neighbour_graph(t.embeddings, "vec_id", "embedding", 5, 0.2, lists).select("a", "b")


@query("V04_neighbours_by_lists")
def v04b(t):
    """Each row against the lists nearest to it: the graph as it is built where all pairs are too many. Recall is held in tests."""
    lists = v.Lists(t.embeddings, "vec_id", "embedding", 8)
    return v.neighbour_graph(t.embeddings, "vec_id", "embedding", 5, 0.2, lists, 6).select("a", "b")


@query("V05_quantised_codes", """SELECT vec_id, len(embedding) // 2 AS n_bytes, round(CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE), 5) AS scale
    FROM embeddings""")
def v05(t):
    return v.quantise(t.embeddings, "vec_id", "embedding").select("vec_id", F.length("codes").cast("long").alias("n_bytes"), F.round("scale", 5).alias("scale"))


def approximate(t, k):
    return v.top_k_quantised(v.code_blocks(t.embeddings, "vec_id", "embedding"), t.embeddings, t.queries_vec, "vec_id", "embedding", k)


@query("V06_quantised_top_k")
def v06(t):
    return approximate(t, 10)


@query("V07_use_codes", """SELECT 'same' AS made_of, count(*) >= 100 AS use_codes FROM embeddings UNION ALL SELECT 'another vector', false UNION ALL SELECT 'a row less', false
    UNION ALL SELECT 'a row more', false UNION ALL SELECT 'too few', false""")
def v07(t):
    """Codes of these very rows; of rows of which one has changed since; of one row less and one more; and of fewer rows than pay."""
    at = lambda rows: v.mark(rows, "vec_id", "embedding")
    rows, first = t.embeddings, F.col("vec_id") == 0
    one = rows.filter(first)
    changed = rows.withColumn("embedding", F.when(first, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    cases = {"same": (rows, 100), "another vector": (changed, 100), "a row less": (rows.filter(~first), 100), "a row more": (rows.unionByName(one.withColumn("vec_id", F.lit(-1).cast("long"))), 100), "too few": (rows, 1 << 40)}
    found = [v.use_codes(at(made_of), at(rows), least).select(F.lit(name).alias("made_of"), "use_codes") for name, (made_of, least) in cases.items()]
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every


@query("V08_to_embed", "SELECT id, name || CASE WHEN category IS NULL THEN '' ELSE ': ' || category END AS to_embed FROM topics WHERE id % 10 = 0")
def v08(t):
    have = t.topics.filter("id % 10 <> 0").select("id")
    return t.topics.join(have, "id", "left_anti").select("id", F.concat_ws(": ", "name", "category").alias("to_embed"))


@query("V09_alignment", """SELECT id, length(split_part(name, ' ', 1)) <= 3 OR length(split_part(name, ' ', 2)) <= 3 OR contains(lower(description),
      lower(split_part(name, ' ', 1))) OR contains(lower(description), lower(split_part(name, ' ', 2))) OR id % 3 = 0 AS aligned
    FROM topics""")
def v09(t):
    near = F.when(F.col("id") % 3 == 0, F.lit(0.5)).when(F.col("id") % 3 == 1, F.lit(0.1))
    return t.topics.select("id", aligned(F.col("name"), F.col("description"), near).alias("aligned"))


@query("R01_topic_search", f"""SELECT qid, id, rank
    FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, id) AS rank
    FROM ({TOPK})
    WHERE rank <= 15 AND score >= 0.1)
    WHERE rank <= 5""")
def r01(t):
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return exact(t, 15).filter("score >= 0.1").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("qid", "id", "rank")


@query("R02_filter_after_top_k", f"SELECT qid, id FROM ({TOPK}) t WHERE rank <= 20 AND id IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def r02(t):
    allowed = t.embeddings.filter("label < 5").select(F.col("vec_id").alias("id"))
    return exact(t, 20).join(allowed.hint("merge"), "id", "left_semi").select("qid", "id")


@query("R02_filter_before_top_k", f"""SELECT qid, id
    FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, id) AS r
    FROM ({TOPK}) t
    WHERE id IN (SELECT vec_id
    FROM embeddings
    WHERE label < 5))
    WHERE r <= 20""")
def r02b(t):
    return v.top_k(t.embeddings.filter("label < 5"), t.queries_vec, "vec_id", "embedding", 20).select("qid", "id")


@query("R03_fused_search", BM25 + f""", vec AS (SELECT qid, id AS doc_id, rank
    FROM ({TOPK})
    WHERE rank <= 50), kw AS (SELECT qid, doc_id, rank
    FROM rk
    WHERE rank <= 50), fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id,
      round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score
    FROM vec a
    FULL
    JOIN kw b ON a.qid = b.qid AND a.doc_id = b.doc_id) SELECT qid, doc_id, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, doc_id) AS rank
    FROM fu)
    WHERE rank <= 20""")
def r03(t):
    vec = exact(t, 50).select("qid", F.col("id").alias("doc_id"), F.col("rank").alias("a"))
    kw = alike(t).best(50).select("qid", "doc_id", F.col("rank").alias("b"))
    part = lambda x: F.coalesce(1 / (60 + F.col(x)), F.lit(0.0))
    both = vec.join(kw.hint("merge"), ["qid", "doc_id"], "full_outer").withColumn("score", F.round(part("a") + part("b"), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 20").select("qid", "doc_id", "rank")


@query("R04_no_tokens", "SELECT p_partkey AS qid, p_size % 4 = 0 AS vector_only FROM part")
def r04(t):
    from loomstead.functions.text import tokens

    asked = t.part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") % 4 == 0, F.lit("a b - ?")).otherwise(F.col("p_name")).alias("query"))
    return asked.select("qid", (F.size(tokens(F.col("query"))) == 0).alias("vector_only"))


INPUTS["probes_vec"] = """SELECT q.vec_id, e.embedding
    FROM queries_vec q
    JOIN embeddings e ON e.vec_id = q.vec_id + 1
    WHERE q.vec_id % 100 = 0"""
PROBED = TOPK.replace("queries_vec", "probes_vec")


@query("R05_pooled_probes", f"""SELECT qid, id, place
    FROM (SELECT qid, id, CASE WHEN n > 5 AND qid % 200 = 0 THEN CASE WHEN spot = 3 THEN 1 WHEN spot < 3 THEN spot + 2 ELSE spot + 1 END ELSE spot + 1 END AS place
    FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, id) - 1 AS spot, count(*) OVER (PARTITION BY qid) AS n
    FROM (SELECT qid, id, max(score) AS score
    FROM (SELECT qid, id, score
    FROM ({TOPK})
    WHERE rank <= 15
    UNION ALL SELECT qid, id, score
    FROM ({PROBED})
    WHERE rank <= 15)
    WHERE score >= 0.2
    GROUP BY 1, 2)))
    WHERE place <= 5""")
def r05(t):
    """The question's own vector, and for every second question the vector of its keyword probe (the next row's); one list; a
    ranking that puts the fourth first where there is one."""
    question = v.top_k(t.embeddings, t.queries_vec, "vec_id", "embedding", 15).filter("score >= 0.2")
    keywords = v.top_k(t.embeddings, t.probes_vec, "vec_id", "embedding", 15).filter("score >= 0.2")
    rankings = t.queries_vec.filter("vec_id % 200 = 0").select(F.col("vec_id").alias("qid"), F.array(F.lit(3.2), F.lit(0.0), F.lit(99.0)).alias("ranking"))
    return r.pooled([question, keywords], rankings, 5).select("qid", "id", "place")


INPUTS["asked_words"] = "SELECT p_partkey AS qid, p_name AS query, split_part(p_type, ' ', 3) AS keyword FROM part WHERE p_partkey % 50 = 0"
UNANSWERED = f"""(SELECT vec_id AS qid
    FROM embeddings
    WHERE vec_id % 50 = 0 AND vec_id NOT IN (SELECT qid
    FROM ({TOPK})
    WHERE rank <= 3 AND qid <> id AND score >= 0.45))"""
KEYWORDED = f"""SELECT qid, id
    FROM (SELECT DISTINCT a.qid, o.id
    FROM (SELECT qid, lower(unnest(list_filter(list_append(string_split(query, ' '), keyword), lambda w: length(w) > 3))) AS word
    FROM asked_words) a
    JOIN {UNANSWERED} u ON u.qid = a.qid
    JOIN topics o ON contains(lower(o.name), word) OR contains(lower(o.description), word))
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 5"""


def unanswered(t):
    answered = exact(t, 3).filter("qid <> id AND score >= 0.45").select("qid").distinct()
    return t.queries_vec.select(F.col("vec_id").alias("qid")).join(answered.hint("merge"), "qid", "left_anti")


def by_keyword(t):
    asked = t.asked_words.select("qid", "query", F.array("keyword").alias("keywords")).join(unanswered(t).hint("merge"), "qid", "left_semi")
    return r.keyword_topics(asked, t.topics.select("id", topic_key(F.col("name")).alias("key"), "description"), 5)


@query("R06_keyword_fallback", f"SELECT qid, id, 0.4 AS score FROM ({KEYWORDED})")
def r06(t):
    return by_keyword(t)


@query("Q03_case_scores", f"""SELECT qid, count(*) FILTER (WHERE l.label = e.label) / 10.0 AS precision_, coalesce(1.0 / min(rank) FILTER (WHERE l.label = e.label AND qid <> id),
      0) AS reciprocal_rank
    FROM ({TOPK}) k
    JOIN embeddings l ON l.vec_id = k.qid
    JOIN embeddings e ON e.vec_id = k.id
    WHERE rank <= 10
    GROUP BY qid""")
def q03(t):
    lab = t.embeddings.select("vec_id", "label")
    rows = exact(t, 10).join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("want")).hint("merge"), "qid").join(lab.select(F.col("vec_id").alias("id"), F.col("label").alias("got")).hint("merge"), "id")
    good = F.col("want") == F.col("got")
    return rows.groupBy("qid").agg((F.count(F.when(good, 1)) / 10).alias("precision_"), F.coalesce(1 / F.min(F.when(good & (F.col("qid") != F.col("id")), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))


@query("Q05_draft_cases", """SELECT topic_id, count(*) AS n, array_to_string(string_split(arg_max(claim_text, length(claim_text) * 100000000 - id), ' ')[:8], ' ') AS claim
    FROM claims
    WHERE status = 'active'
    GROUP BY topic_id
    HAVING count(*) >= 3""")
def q05(t):
    longest = F.max_by("claim_text", F.struct(F.length("claim_text"), -F.col("id")))
    rows = t.claims.filter("status = 'active'").groupBy("topic_id").agg(F.count("*").alias("n"), longest.alias("claim")).filter("n >= 3")
    return rows.withColumn("claim", F.array_join(F.slice(F.split("claim", " "), 1, 8), " "))
