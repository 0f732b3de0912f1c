"""Inverted lists, codes, bitmap searches, pooled and keyword retrieval, streams whose state ends."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead import streaming
from loomstead.functions import text
from loomstead.operators import graph, retrieval, vectors
from loomstead.plans.context import perturbed
from loomstead.sources.keyed import KeyedTable


def pairs_of(df):
    return {tuple(x) for x in df.select("qid", "id").collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors, a third of them in one of 20 directions; some rows have none."""
    r = np.random.default_rng(4)
    centre = r.normal(size=(20, 32))
    of = np.where(r.random(2000) < 0.33, 0, r.integers(0, 20, 2000))
    rows = [(i, (centre[c] + r.normal(size=32) * 0.7).astype(float).tolist()) for i, c in enumerate(of)]
    return spark.createDataFrame([*rows, (5000, None), (5001, []), (None, rows[0][1])], "id long, v array<float>").repartition(3)


def test_lists_with_all_probes_are_exact_and_with_some_nearly(clustered, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_FLOATS", 32 * 64 * 4)  # blocks of 64 rows
    monkeypatch.setattr(vectors.Lists, "BLOCKS_A_SALT", 2)
    asked = clustered.filter("id % 50 = 0")
    exact = vectors.top_k(clustered, asked, "id", "v", 10)
    lists = vectors.Lists(clustered, "id", "v", 16, sample=500)
    assert lists.blocks.agg(F.sum(F.octet_length("ids") / 8)).first()[0] == 2000  # every row is indexed
    assert lists.sizes.agg(F.max("salts")).first()[0] > 1
    found = lists.top_k(asked, "id", "v", 10).sort("qid", "rank").collect()
    assert [(x.qid, x.id) for x in found] == [(x.qid, x.id) for x in exact.sort("qid", "rank").collect()] and len(found) == 400
    want = pairs_of(exact)
    assert len(pairs_of(lists.top_k(asked, "id", "v", 10, 4)) & want) >= 0.9 * len(want)


def test_lists_recall_on_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0")
    want = pairs_of(vectors.top_k(rows, asked, "vec_id", "embedding", 10))
    got = pairs_of(vectors.Lists(rows, "vec_id", "embedding", 8).top_k(asked, "vec_id", "embedding", 10, 6))
    assert len(got & want) >= 0.9 * len(want)


def test_lists_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "id long, v array<float>")
    assert vectors.Lists(none, "id", "v", 4).top_k(none, "id", "v", 3).count() == 0
    assert vectors.top_k(none, none, "id", "v", 3).count() == 0
    with pytest.raises(ValueError):
        vectors.Lists(none, "id", "v", 0)


@pytest.mark.parametrize("sf_", ["sf0.01", "sf0.1"])
def test_codes_recall_on_the_tables(spark, sf_):
    rows = spark.read.parquet(f"/root/testdata/{sf_}/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0")
    want = pairs_of(vectors.top_k(rows, asked, "vec_id", "embedding", 10))
    got = pairs_of(vectors.top_k_quantised(vectors.code_blocks(rows, "vec_id", "embedding"), rows, asked, "vec_id", "embedding", 10))
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_noise_is_seeded_of_its_level_and_keeps_length(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=256).astype(float).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for level in (0.0, 0.1, 0.5):
        got = {x.id: np.array(x.v) for x in perturbed(df, "id", "v", level).collect()}
        again = {x.id: np.array(x.v) for x in perturbed(df.repartition(5), "id", "v", level).collect()}
        for i, v in rows:
            v = np.array(v)
            assert (got[i] == again[i]).all() and abs(np.linalg.norm(got[i]) - np.linalg.norm(v)) < 1e-3
            cos = got[i] @ v / np.linalg.norm(got[i]) / np.linalg.norm(v)  # noise of level x RMS turns a vector by about atan(level)
            assert abs(np.tan(np.arccos(min(1.0, cos))) - level) < 0.12


def test_rank_by_codes_counts_what_scores_above(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=16).astype(float).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    asked, codes = df.filter("id % 100 = 7"), vectors.code_blocks(df, "id", "v")
    wanted = spark.createDataFrame([(7, 3), (107, 107), (207, 4), (307, 9999)], "qid long, id long")
    got = {x.qid: x.place for x in vectors.rank_by_codes(codes, asked, wanted, "id", "v").collect()}
    order = {}
    for x in vectors.top_k_codes(codes, asked, "id", "v", 500).collect():
        order.setdefault(x.qid, {})[x.id] = x.score
    want = {q: 1 + sum(s > order[q][i] for s in order[q].values()) for q, i in ((7, 3), (107, 107), (207, 4))}
    assert got == want


def test_recall_report_by_hand(spark):
    exact = spark.createDataFrame([(q, i, i) for q in (4, 5) for i in range(1, 21)], "qid long, id long, rank long")
    near = spark.createDataFrame([(4, i, i) for i in range(1, 21)] + [(5, i, 21 - i) for i in range(3, 21)], "qid long, id long, near long")
    place = spark.createDataFrame([(4, 1), (5, 30)], "qid long, place long")
    got = retrieval.recall_report(exact, near, place, (F.col("qid") % 2).cast("double")).collect()
    assert sorted(tuple(x) for x in got) == [(0.0, 1, 1.0, 1.0, 1.0, 1.0, "OK"), (1.0, 1, 0.0, 0.9, 0.0, 30.0, "MARGINAL")]


def test_rotation_keeps_products():
    r = np.random.default_rng(1)
    m = r.normal(size=(9, 37)).astype(np.float32)
    assert np.allclose(vectors.rotated(m) @ vectors.rotated(m).T, m @ m.T, atol=1e-4)


def test_code_products_are_those_of_the_levels():
    r = np.random.default_rng(2)
    for width in (1, 2, 5, 64):
        rows, asked = (vectors._unit(r.normal(size=(n, width)).astype(np.float32)) for n in (40, 6))
        q = vectors._levels(vectors.rotated(asked), 127).astype(np.int8)
        got = vectors._code_products(q.tobytes(), np.ascontiguousarray(vectors._coded(rows), np.uint8).tobytes(), width)
        level = vectors._levels(vectors.rotated(rows), 7)
        want = (q.astype(float) @ level.T) / np.linalg.norm(level, axis=1) / np.linalg.norm(q.astype(float), axis=1)[:, None]
        assert np.allclose(got, want, atol=1e-5)


def slow_depths(starts, edges, depth):
    out = {}
    for s in starts:
        found = {s: 0}
        front = [s]
        for d in range(1, depth + 1):
            front = [b for a, b in edges if a in set(front) and b not in found]
            found |= {b: d for b in front}
        out |= {(s, n): d for n, d in found.items()}
    return out


def test_bitmap_search_equals_a_slow_one(spark):
    r = random.Random(3)
    edges = {(a, b) for a, b in ((r.randrange(300), int(r.paretovariate(1)) % 300) for _ in range(500))}
    both = edges | {(b, a) for a, b in edges}
    starts = list(range(0, 300, 2))  # more than two words of 64
    df = spark.createDataFrame([*both, (1, None), (None, 2)], "a long, b long")
    got = graph.search_depths(spark.createDataFrame([(s,) for s in [*starts, 4, None]], "node long"), df.unionByName(df), 3)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and {x[:2]: x[2] for x in rows} == slow_depths(starts, both, 3)
    assert graph.search_depths(spark.createDataFrame([], "node long"), df, 2).count() == 0


def test_overview_grows_bridges_and_drops(spark):
    nodes = [(i, i in (1, 2, 9), 0, i % 2) for i in range(1, 12)] + [(None, True, 0, 1)]
    edges = [(1, 3), (2, 3), (1, 4), (2, 4), (1, 5), (9, 10), (4, 1), (7, 7), (1, 99), (None, 3)]
    n, e = spark.createDataFrame(nodes, "node long, matched boolean, claims long, community int"), spark.createDataFrame(edges, "a long, b long")
    view = graph.Overview(n, e, 5)  # 1, 2 and 9, then the bridges 3 and 4; 9 has nobody
    assert {tuple(x) for x in view.edges().collect()} == {(1, 3), (2, 3), (1, 4), (2, 4)}
    assert {(x.node, x.degree, x.total_degree, x.hit) for x in view.nodes().collect()} == {(1, 2, 3, True), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False)}
    assert tuple(view.counts().first()) == (11, 6, 7, 4, 0, 1, False)
    assert tuple(graph.Overview(n, e, 2).counts().first())[4:] == (1, 2, True)
    grown = graph.Overview(n, e, 4, grow=True)  # 1, 2, 9 and the first neighbour of 1
    assert {x.node for x in grown.nodes().collect()} == {1, 2, 3}
    assert graph.Overview(n.limit(0), e, 5).nodes().count() == 0
    assert {tuple(x) for x in view.communities().collect()} == {(0, 2), (1, 2)}


def test_pooled_lists_take_the_best_score_and_a_repaired_ranking(spark):
    one = spark.createDataFrame([(1, i, 1 - i / 10) for i in range(4)] + [(2, 5, 0.5)], "qid long, id long, score double")
    two = spark.createDataFrame([(1, 3, 0.95), (1, 7, 0.1), (3, 1, 0.2)], "qid long, id long, score double")
    ranks = spark.createDataFrame([(1, [4.0, float("nan"), 4.9, 0.0]), (2, [3.0]), (4, None)], "qid long, ranking array<double>")
    got = sorted((x.qid, x.place, x.id) for x in retrieval.pooled([one, two], ranks, 3).collect())
    assert got == [(1, 1, 7), (1, 2, 0), (1, 3, 3), (2, 1, 5), (3, 1, 1)]  # by score: 0, 3, 1, 2, 7
    assert sorted((x.qid, x.place, x.id) for x in retrieval.pooled([one, two], None, 3).collect())[:3] == [(1, 1, 0), (1, 2, 3), (1, 3, 1)]


def test_keywords_find_parts_of_folded_texts(spark):
    topics = [(1, "rizeni projektu", None), (2, "skoleni", "Školení ŘÍZENÍ staff"), (3, "other", "100% matched_text"), (4, None, None), (5, "rizen", "no")]
    asked = [(1, "Řízení a x", None), (2, "%", ["d_te"]), (3, None, [" ", "abc"]), (4, "matched", ["skol"]), (5, "zzzzzz rizenix", [])]
    got = retrieval.keyword_topics(spark.createDataFrame(asked, "qid long, query string, keywords array<string>"), spark.createDataFrame(topics, "id long, key string, description string"), 2)
    assert sorted(tuple(x) for x in got.collect()) == [(1, 1, 0.4), (1, 2, 0.4), (2, 3, 0.4), (4, 2, 0.4), (4, 3, 0.4)]


def test_fold_is_letter_by_letter(spark):
    letters = [*text.SINGLE, *text.SEVERAL, "a", "Z", "́", "中", "ࠀ", "한", "あ", "\U0001f642"]
    said = {c: text.SINGLE.get(c, text.SEVERAL.get(c, "" if c == "́" else c)) for c in letters}
    rows = [(f"x{c}y {c}{c}", f"x{v}y {v}{v}") for c, v in said.items()] + [("plain", "plain"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(text.fold(F.col("a")).alias("f"), "b").collect()
    assert [x.f for x in got] == [x.b for x in got]


def test_a_keyed_table_takes_batches_once_and_rewrites_what_they_touch(spark, tmp_path):
    schema = "k string, n long, v long"
    table = KeyedTable.create(spark, f"{tmp_path}/t", schema, ["k"], 8)
    assert table.read().count() == 0
    r, want = random.Random(2), {}
    add = lambda new: lambda old: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    for number in range(4):
        rows = [(r.choice(["a", "b", "c", None, ""]), 1, r.randrange(99)) for _ in range(3 if number else 40)]
        new = spark.createDataFrame(rows, schema).groupBy("k").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
        before = table._now()[2]
        assert table.apply(number, new, add(new)) and not table.apply(number, new, add(new))
        for k, n, v in rows:
            want[k] = (want.get(k, (0, 0))[0] + n, max(want.get(k, (0, 0))[1], v))
        assert {x.k: (x.n, x.v) for x in table.read().collect()} == want
        hit = {x[0] for x in new.select(table._bucket()).distinct().collect()}
        assert {b: f for b, f in table._now()[2].items() if b not in hit} == {b: f for b, f in before.items() if b not in hit}
    again = KeyedTable(spark, f"{tmp_path}/t", schema, ["k"], 8)  # another run
    assert again.apply(9, again.read().limit(0), lambda old: old) and {x.k: (x.n, x.v) for x in again.read().collect()} == want
    gone = again.read().filter("k = 'a'").select("k")
    assert again.apply(10, gone, lambda old: old.filter("NOT k <=> 'a'")) and again.read().filter("k = 'a'").count() == 0
    assert {x.k for x in again.read().collect()} == set(want) - {"a"}


def test_communities_do_not_fall_apart(spark):
    r = random.Random(21)
    pairs = {tuple(sorted((r.randrange(120), r.randrange(120)))) for _ in range(260)}
    pairs = {p for p in pairs if p[0] != p[1]}
    both = pairs | {(b, a) for a, b in pairs}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in both], "a long, b long, weight double")
    of = {x.node: x.community for x in graph.communities(edges).collect()}
    assert set(of) == {a for a, _ in both}
    for c in set(of.values()):
        nodes = {n for n in of if of[n] == c}
        reached, todo = set(), [min(nodes)]
        while todo:
            n = todo.pop()
            if n not in reached:
                reached.add(n)
                todo += [b for a, b in both if a == n and b in nodes]
        assert reached == nodes


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", name).load().count()


def test_throttle_state_ends_with_its_windows(spark, tmp_path):
    """Three runs over files that arrive one after another, against the batch form over all of them; then time passes."""
    r = random.Random(6)
    rows = [(i, 1 if i % 3 else r.randint(2, 9), i * 40 + r.randint(0, 30)) for i in range(300)]
    frame = lambda part: spark.createDataFrame(part, "id long, user long, s long").selectExpr("id", "user", "timestamp_seconds(s) AS created_at")
    want = {x.id: x.allowed for x in streaming.throttle(frame(rows), "user", 2, 300.0).collect()}
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"
    for part in (rows[:120], rows[120:121], rows[121:], [(999, 77, 10**6)], [(1000, 78, 2 * 10**6)]):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        stream = streaming.read(spark, source, frame(rows).schema)
        got = {x.id: x.allowed for x in streaming.drained(streaming.throttle_stream(stream, "user", 2, 300.0, "10 seconds"), folder=folder).collect()}
    assert {k: v for k, v in got.items() if k < 999} == want
    assert state_rows(spark, folder, "window") == 1  # the last event's; every other window has ended


def test_expiry_leaves_the_state(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"
    schema = "id string, until long, seen long"
    frame = lambda part: spark.createDataFrame(part, schema).selectExpr("id", "timestamp_seconds(until) AS until", "timestamp_seconds(seen) AS seen")
    for part in ([("a", 100, 10), ("b", 500, 11), ("c", None, 12), ("d", 5, 12), (None, 7, 12)], [("b", 90, 50), ("e", 1000, 60)], [("f", 5000, 2000)]):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        out = streaming.drained(streaming.expired_stream(streaming.read(spark, source, frame([]).schema), "id", "until", "seen"), folder=folder)
    assert sorted((x.id, x.until.timestamp()) for x in out.collect()) == [("a", 100), ("b", 90), ("d", 5), ("e", 1000)]
    assert state_rows(spark, folder, "until") == 1  # f, which is to expire yet
