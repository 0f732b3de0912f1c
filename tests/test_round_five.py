"""Tests of the findings of round 3, second part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead import storage
from loomstead.operators import facts, graph, retrieval, vectors


def test_verdicts_that_supersede_nothing_are_no_group(spark):
    new = spark.range(400).select("id")
    verdict = F.when(F.col("id") % 4 == 0, "update").otherwise("conflict")
    verdicts = new.select("id", verdict.alias("verdict"), F.when(verdict == "update", F.col("id") % 40).alias("supersedes"), F.lit(True).alias("aligned"))
    for rows in (None, 400, 1_000_000):
        out = facts.apply_verdicts(new, verdicts, rows)
        assert sorted(r.id for r in out.filter("retires IS NOT NULL").collect()) == list(range(0, 40, 4)) and out.count() == 400
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "[supersedes" in plan and ", lone_" in next(x for x in plan.splitlines() if "Window [" in x)


@pytest.mark.parametrize("a_task", [7, 250_000])
def test_weights_are_added_in_as_many_tasks_as_edges_need(spark, monkeypatch, a_task):
    monkeypatch.setattr(storage, "ROWS_A_TASK", a_task)
    rows = [(1, 2, "is_part_of"), (2, 1, "depends_on"), (1, 1, "uses"), (2, 3, "odd"), (None, 3, "uses")] + [(i, i + 50, "uses") for i in range(10, 40)]
    out = graph.weighted(spark.createDataFrame(rows, "a long, b long, rel string"), "rel")
    want = {(1, 2): 1.7, (2, 3): 0.3} | {(i, i + 50): 0.4 for i in range(10, 40)}
    assert {(r.a, r.b): r.weight for r in out.collect()} == want | {(b, a): w for (a, b), w in want.items()}
    assert out.rdd.getNumPartitions() == (1 if a_task > 7 else 5)


@pytest.mark.parametrize("a_task", [7, 250_000])
def test_links_are_found_in_as_many_tasks_as_edges_need(spark, monkeypatch, a_task):
    monkeypatch.setattr(storage, "ROWS_A_TASK", a_task)
    asked, real = [], graph.dealt
    monkeypatch.setattr(graph, "dealt", lambda df, rows, *keys: asked.append(rows) or real(df, rows, *keys))
    chain = [(i + 1, i) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (5, 5), (7, 8), (8, 7)]
    found = {r.node: r.root for r in graph.links(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in (100, 101, 102)}
    assert len(asked) >= 3 and asked[0] == len(chain) - 1


@pytest.mark.parametrize("a_task", [7, 250_000])
def test_edges_of_communities_are_not_shuffled_again(spark, monkeypatch, a_task):
    monkeypatch.setattr(storage, "ROWS_A_TASK", a_task)
    ends = [(a, b) for c in range(3) for a in range(6 * c, 6 * c + 6) for b in range(6 * c, 6 * c + 6) if a < b] + [(5, 6), (11, 12)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ends] + [(b, a, 1.0) for a, b in ends], "a long, b long, weight double")
    of = {r.node: r.community for r in graph.communities(edges).collect()}
    assert of == {i: i // 6 + 1 for i in range(18)}
    near, strength = graph._neighbours(storage.kept(edges, "test-edges"))
    plan = graph._told(near, strength, 1_000_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Bucketed: true" in plan
    assert dict(strength.collect()) == {i: 5.0 + (i in (5, 6, 11, 12)) for i in range(18)}


@pytest.mark.parametrize("pairs", [5, 1 << 21])
def test_community_hits_neither_shuffle_nor_hold_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(retrieval, "PAIRS_A_TASK", pairs)
    reports = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (2, 11, 0.5), (3, 10, 0.01), (4, None, 0.9), (4, 11, 0.8), (4, 12, 0.7)], "qid long, community int, score double")
    members = spark.createDataFrame([(10, i) for i in range(20)] + [(11, i) for i in range(15, 30)] + [(12, 99), (None, 98), (11, 29)], "community int, id long")
    out = retrieval.community_hits(reports, members, 0.05, 2)
    want = [(1, i) for i in range(30)] + [(2, i) for i in range(15, 30)] + [(4, i) for i in range(15, 30)]
    assert sorted((r.qid, r.id) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and (pairs > 5 or out.rdd.getNumPartitions() > 10)


def test_scores_are_computed_in_tiles(monkeypatch):
    r = np.random.default_rng(3)
    q, m = vectors._unit(r.standard_normal((70, 8)).astype("f4")), vectors._unit(r.standard_normal((90, 8)).astype("f4"))
    monkeypatch.setattr(vectors, "TILE_SCORES", 100)
    sizes, best = [], {}
    for i, n, ids, scores in vectors._scored(q.tobytes(), 70, m.tobytes(), np.arange(90), 8, vectors._products):
        sizes.append(scores.size)
        best.setdefault(i, vectors._Best(n, 3)).see(ids, scores)
    whole = vectors._Best(70, 3)
    whole.see(np.arange(90), q @ m.T)
    assert max(sizes) <= 100 and sum(sizes) == 70 * 90
    assert sorted((i + int(a), int(b)) for i, x in best.items() for a, b in zip(x.q, x.id, strict=True)) == sorted(zip(whole.q.tolist(), whole.id.tolist(), strict=True))


def test_candidates_that_are_handed_on_early_change_nothing(spark):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(4)]) for i in range(300)], "id long, v array<float>").repartition(3)
    asked = storage.kept(vectors.packed(rows, "id", "v"), "test-asked")
    real = sorted(map(tuple, vectors.top_k(rows, rows, "id", "v", 4).collect()))
    met = vectors._ranked(vectors._meet(vectors.packed(rows, "id", "v"), asked, 4, vectors._products, held=10).withColumn("score", F.round("score", 5)), 4)
    assert sorted(map(tuple, met.collect())) == real and len(real) == 1200
