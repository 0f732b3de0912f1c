"""Tests of the findings of round 3."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstead.llm import lm
from loomstead.operators import corpus, graph


def copies(spark, n: int):
    r = random.Random(n)
    words = ["red", "redder", "ring", "bolt", "plate", "old", "cold", "hot", "a", "Éclair"]
    rows = [(7 * i % 1009, " ".join(r.choices(words, k=r.choice([1, 2, 3])))) for i in range(n)]
    rows += [(2000, None), (2001, ""), (2002, "ring red"), (2003, "RED, ring"), (2004, "a b")]
    asked = [(0, "red ring"), (1, "ring red"), (2, "Ring"), (3, None), (4, "a ?"), (5, "none"), (6, "red bolt old"), (7, "cold cold"), (8, "eclair red")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")


@pytest.mark.parametrize("n", [0, 6, 400])
def test_classes_rank_as_all_documents_do(spark, n):
    docs, asked = copies(spark, n)
    index = corpus.inverted_index(docs, "doc_id", "text")
    alike = corpus.Alike(docs, asked, "doc_id", "text")
    for k in (1, 10):
        want = corpus.bm25(index, asked, "doc_id", k).select("qid", "doc_id", "score", "rank")
        assert sorted(map(tuple, alike.best(k).collect())) == sorted(map(tuple, want.collect()))
    want = corpus.bm25(index, asked, "doc_id").groupBy("doc_id").agg(F.count("*"), F.min("rank"))
    assert sorted(map(tuple, alike.matches().collect())) == sorted(map(tuple, want.collect()))


def test_hits_do_not_grow_with_copies(spark):
    docs, asked = copies(spark, 300)
    more = docs.withColumn("c", F.explode(F.array(*map(F.lit, range(9))))).select((F.col("doc_id") + 10_000 * F.col("c")).alias("doc_id"), "text")
    again = asked.unionByName(asked.withColumn("qid", F.col("qid") + 100))
    one, ten = corpus.Alike(docs, asked, "doc_id", "text"), corpus.Alike(more, again, "doc_id", "text")
    assert one.scores.count() == ten.scores.count() < corpus.bm25(corpus.inverted_index(more, "doc_id", "text"), again, "doc_id").count() / 9


def test_starts_with_enough_near_them_are_not_searched_further(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 20)] + [(i, i + 100) for i in range(1, 20)] + [(500, 501), (501, 502)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    start = spark.createDataFrame([(0,), (500,), (600,)], "node long")
    asked, search = [], graph.search_depths
    monkeypatch.setattr(graph, "search_depths", lambda start, edges, d: asked.append((d, sorted(r.node for r in start.collect()))) or search(start, edges, d))
    found = sorted(map(tuple, graph.ego(start, both, degree, 2, 15).collect()))
    assert found == [(0, i, 1) for i in range(1, 16)] + [(500, 501, 1), (500, 502, 2)]
    assert asked == [(1, [0, 500, 600]), (2, [500, 600])]


def test_cycles_are_broken_without_a_broadcast(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 4), (5, 99), (6, None), (7, 6), (8, 7)], "id long, parent_id long")
    out = graph.break_cycles(rows)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (2, None), (3, None), (4, None), (5, None), (6, None), (7, 6), (8, 7)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_every_history_is_kept():
    h = np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = np.repeat([0, 1], 100)
    at, before = lm.kept_histories(row, h, np.ones(200, bool))
    assert at.tolist() == [*range(4, 100), *range(104, 200)] and len(set(before.tolist())) == 192


def test_chunks_of_a_batch_are_not_held_together():
    batch = pd.DataFrame({"doc_id": range(1200), "good_": True, "at_": 0, "part_": "one part of a text"})
    out = list(corpus._recut(["doc_id"], 4000)(iter([batch])))
    assert [len(x) for x in out] == [500, 500, 200]
    assert pd.concat(out)["doc_id"].tolist() == list(range(1200)) and set(out[0].columns) == {"doc_id", "at_", "sub_", "content"}
