"""Queries from hits to contexts (R07 to R10), of report inputs (G10, G13) and of measurement (Q02, Q04)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomstead.operators import graph as g
from loomstead.operators import reports as rp
from loomstead.operators import retrieval as r
from loomstead.operators import vectors as v
from loomstead.plans.graph import IN_COMMUNITY, weights
from loomstead.plans.registry import INPUTS, query
from loomstead.plans.search import KEYWORDED, TOPK, UNANSWERED, by_keyword, exact, unanswered
from loomstead.storage import kept

INPUTS["first_of_label"] = "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label"


def reports(t):
    """Each label's first vector stands for its report."""
    rows = t.embeddings.join(t.first_of_label.select("vec_id"), "vec_id", "left_semi")
    hits = v.top_k(rows, t.queries_vec, "vec_id", "embedding", 10)
    return hits.join(t.first_of_label.select(F.col("vec_id").alias("id"), F.col("label").alias("community")).hint("merge"), "id").select("qid", "community", "score")


@query("R07_community_search", f"""SELECT qid, e.vec_id AS id
    FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, label) AS n
    FROM ({TOPK}) k
    JOIN first_of_label f ON f.vec_id = k.id
    WHERE score >= 0.05) h
    JOIN embeddings e ON e.label = h.label
    WHERE n <= 2""")
def r07(t):
    members = t.embeddings.select(F.col("label").alias("community"), F.col("vec_id").alias("id"))
    return r.community_hits(reports(t), members, 0.05, 2).select("qid", "id")


INPUTS["member_claims"] = """SELECT e.label AS community, e.vec_id AS id, o.name, coalesce(k.n, 0) AS claims
    FROM embeddings e
    LEFT JOIN topics o ON o.id = e.vec_id
    LEFT JOIN (SELECT topic_id, count(*) AS n FROM claims WHERE status = 'active' GROUP BY topic_id) k ON k.topic_id = e.vec_id"""


@query("R07_thematic_fallback", f"""WITH keyworded AS (SELECT qid FROM ({KEYWORDED}) WHERE qid % 100 = 50),
    near AS (SELECT k.qid, f.label AS community
    FROM ({TOPK}) k
    JOIN first_of_label f ON f.vec_id = k.id
    WHERE k.score >= 0.05 AND k.qid IN {UNANSWERED} AND k.qid NOT IN (SELECT qid FROM keyworded)
    QUALIFY row_number() OVER (PARTITION BY k.qid ORDER BY k.score DESC, f.label) <= 2)
    SELECT DISTINCT n.qid, m.id, 0.35 AS score
    FROM near n
    JOIN (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY claims DESC, name NULLS FIRST, id) AS place FROM member_claims) m ON m.community = n.community
    WHERE place <= 5""")
def r07b(t):
    """Questions that neither a topic's vector nor a keyword answers (every second one has none)."""
    left = unanswered(t).join(by_keyword(t).filter("qid % 100 = 50").select("qid").distinct().hint("merge"), "qid", "left_anti")
    return r.thematic_topics(left, reports(t), t.member_claims, 0.05, 2, 5)


INPUTS["starts"] = "SELECT node AS id, CAST(floor(node / 50) AS BIGINT) % 7 AS qid FROM graph_nodes WHERE node % 50 = 0"


@query("R08_one_hop", """WITH e AS (SELECT a, b, round(sum(CAST(CASE rel WHEN 'is_part_of' THEN 1.0 WHEN 'depends_on' THEN 0.7 ELSE 0.3 END AS DOUBLE)), 6) AS weight FROM (SELECT source_id AS a, target_id AS b, rel FROM topic_edges UNION ALL SELECT target_id, source_id, rel FROM topic_edges) GROUP BY 1, 2),
n AS (SELECT qid, b AS id, max(weight) AS weight FROM starts JOIN e ON a = id GROUP BY 1, 2), x AS (SELECT n.*, row_number() OVER (PARTITION BY n.qid ORDER BY weight DESC, n.id) AS p FROM n ANTI JOIN starts s ON s.qid = n.qid AND s.id = n.id)
SELECT qid, id, 0.9 AS score FROM starts UNION ALL SELECT x.qid, x.id, 0.5 FROM x JOIN (SELECT qid, count(*) AS have FROM starts GROUP BY 1) h ON h.qid = x.qid WHERE p <= have""")
def r08(t):
    edges = g.weighted(t.topic_edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "rel"), "rel")
    return r.expand(t.starts.select("qid", "id", F.lit(0.9).alias("score")), edges)


def slots(t):
    c = t.claims.select(F.col("id").alias("claim_id"), "claim_type", "status", (F.col("topic_id") % 20).alias("qid"), F.round((F.col("id") % 97) / 100, 2).alias("score"))
    return r.claim_slots(c.filter("status = 'conflicted' AND claim_id % 4 = 0"), c.filter("status = 'active' AND score > 0.9"), c.filter("status = 'active' AND claim_id % 5 = 0"), 60, F.col("qid") % 2 == 0, ["rule"])


SLOTS = """SELECT qid, claim_id, round(score * CASE WHEN qid % 2 = 0 AND claim_type = 'rule' THEN 1.5 ELSE 1 END, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, score DESC, claim_id) AS place FROM
(SELECT qid, claim_id, claim_type, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, claim_id ORDER BY rank) AS f FROM (SELECT topic_id % 20 AS qid, id AS claim_id, claim_type, 0 AS rank, 0.2::DOUBLE AS score FROM claims WHERE status = 'conflicted' AND id % 4 = 0
UNION ALL SELECT topic_id % 20, id, claim_type, 1, round((id % 97) / 100, 2)::DOUBLE FROM claims WHERE status = 'active' AND round((id % 97) / 100, 2) > 0.9 UNION ALL SELECT topic_id % 20, id, claim_type, 2, 0.3::DOUBLE FROM claims WHERE status = 'active' AND id % 5 = 0)) WHERE f = 1)) WHERE place <= 60 OR rank = 0"""


@query("R09_claim_slots", SLOTS)
def r09(t):
    return slots(t).select("qid", "claim_id", "score", "place")


@query("R10_contexts", f"""WITH topical AS (SELECT s.qid, c.topic_id, max(s.score) AS score, count(DISTINCT c.claim_text) AS n, bool_or(c.status = 'conflicted') AS d,
    '## ' || c.topic_id || chr(10) || string_agg(DISTINCT CASE WHEN c.status = 'conflicted' THEN '[disputed] ' ELSE '- ' END || c.claim_text, chr(10)
    ORDER BY CASE WHEN c.status = 'conflicted' THEN '[disputed] ' ELSE '- ' END || c.claim_text) AS body
    FROM ({SLOTS}) s
    JOIN claims c ON c.id = s.claim_id
    GROUP BY 1, 2)
    SELECT qid, count(*) AS n_topics, CAST(sum(n) AS BIGINT) AS n_claims, bool_or(d) AS disputed,
    string_agg(body, chr(10) || chr(10) ORDER BY score DESC, CAST(topic_id AS VARCHAR)) AS context
    FROM topical
    GROUP BY qid""")
def r10(t):
    c = t.claims.select(F.col("id").alias("claim_id"), F.col("topic_id").cast("string").alias("topic"), "status", "claim_text")
    return r.contexts(slots(t).join(c.hint("merge"), "claim_id"))


@query("G10_assigned_and_noise", """SELECT count(*) FILTER (WHERE node IN (SELECT a
    FROM graph_edges) OR node IN (SELECT b
    FROM graph_edges)) AS assigned, count(*) FILTER (WHERE node NOT IN (SELECT a
    FROM graph_edges) AND node NOT IN (SELECT b
    FROM graph_edges)) AS noise
    FROM graph_nodes""")
def g10(t):
    of = g.communities(weights(t), rounds=4, levels=1)
    return t.graph_nodes.join(of, "node", "left").agg(F.count("community").alias("assigned"), F.count(F.when(F.col("community").isNull(), 1)).alias("noise"))


@query("G13_report_inputs", f"""WITH t AS (SELECT community, id, name, count(*) OVER (PARTITION BY community) AS n FROM placed_topics WHERE {IN_COMMUNITY})
    SELECT community, 'topic' AS kind, NULL AS place, name AS text FROM t
    UNION ALL SELECT community, 'claim', row_number() OVER (PARTITION BY community ORDER BY topic_id, r) AS place, claim_text
    FROM (SELECT c.*, t.community, t.n, row_number() OVER (PARTITION BY topic_id ORDER BY created_at, c.id) AS r FROM active_claims c JOIN t ON t.id = topic_id)
    WHERE r <= ceil(40 / n)
    QUALIFY place <= 40
    UNION ALL SELECT s.community, 'relation', row_number() OVER (PARTITION BY s.community ORDER BY source_id, target_id, rel) AS place, s.name || ' \u2014' || rel || '\u2192 ' || o.name
    FROM inner_edges e
    JOIN t s ON s.id = e.source_id
    JOIN t o ON o.id = e.target_id AND o.community = s.community
    QUALIFY place <= 30""")
def g13(t):
    return rp.inputs(t.placed_topics, t.active_claims, t.inner_edges)


def perturbed(rows, key: str, vector: str, level: float):
    """Vectors with Gaussian noise of `level` times their root mean square, seeded by the key, brought back to their length."""

    def run(batches):
        for b in batches:
            out = []
            for k, x in zip(b[key], b[vector], strict=True):
                x = np.asarray(x, np.float64)
                y = x + np.random.default_rng(int(k)).standard_normal(len(x)) * level * np.sqrt(np.mean(x * x))
                out.append((y * np.linalg.norm(x) / max(np.linalg.norm(y), 1e-12)).astype(np.float32))
            yield pd.DataFrame({key: b[key], vector: out})

    return rows.select(key, vector).mapInPandas(run, f"{key} long, {vector} array<float>")


@query("Q02_noisy_queries", "SELECT vec_id, len(embedding) AS n, true AS same_length FROM queries_vec")
def q02(t):
    norm = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    noisy = perturbed(t.queries_vec, "vec_id", "embedding", 0.3).withColumnRenamed("embedding", "noisy")
    return noisy.join(t.queries_vec.hint("merge"), "vec_id").select("vec_id", F.size("noisy").cast("long").alias("n"), (F.abs(norm("noisy") - norm("embedding")) < 1e-4).alias("same_length"))


NOISE = [0.0, 0.1, 0.3, 0.5]


@query("Q01_recall")
def q01(t):
    """For each noise level: recall at 10 and 20 of the scan by codes against the exact one, how often it keeps the exact best first, the mean
    rank that the exact best has among all codes, and the band of the recall at 20. Held against a slow version in tests."""
    rows = [perturbed(t.queries_vec, "vec_id", "embedding", x).select((F.col("vec_id") * len(NOISE) + i).alias("vec_id"), "embedding") for i, x in enumerate(NOISE)]
    asked = rows[0]
    for other in rows[1:]:
        asked = asked.unionByName(other)
    asked = kept(asked, "noisy-queries")
    exact_ = kept(v.top_k(t.embeddings, asked, "vec_id", "embedding", 20, 9), "noisy-exact")
    codes = v.code_blocks(t.embeddings, "vec_id", "embedding")
    near = v.top_k_codes(codes, asked, "vec_id", "embedding", 20).select("qid", "id", F.col("rank").alias("near"))
    place = v.rank_by_codes(codes, asked, exact_.filter("rank = 1").select("qid", "id"), "vec_id", "embedding")
    return r.recall_report(exact_, near, place, F.element_at(F.array(*map(F.lit, NOISE)), (F.col("qid") % len(NOISE) + 1).cast("int")))


@query("Q04_summary", f"SELECT count(*) AS n_queries, round(avg(score), 5) AS mean_best, round(quantile_cont(score, 0.5), 5) AS median_best FROM ({TOPK}) WHERE rank = 2")
def q04(t):
    return exact(t, 2).filter("rank = 2").agg(F.count("*").alias("n_queries"), F.round(F.avg("score"), 5).alias("mean_best"), F.round(F.percentile("score", F.lit(0.5)), 5).alias("median_best"))
