"""The corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstead.llm import decontaminate, jaccard, kernels, licenses, linededup, lm, mixing, quality, queries, sharding, suffixes, toxicity
from loomstead.llm.common import documents
from tests.oracle import compare, database, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[\x20\x09-\x0D]+"
rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(SPACE, low) if w]


BASE = prose(120, 1)
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "a", 1),
    (3, BASE.replace(BASE.split()[60], "changed", 1), "en", "b", 1),
    (4, prose(200, 2), "en", "b", 1),
    (4, prose(200, 2), "en", "b", 1),
    (5, None, None, None, None),
    (6, "", "de", "a", 0),
    (7, " \n\t", "de", None, 3),
    (8, "one", "de", "c", 3),
    (9, "ONE", "de", "c", 3),
    (10, "one two", "de", "c", 7),
    (None, prose(30, 3), "en", "a", 1),
    (None, prose(40, 4), "en", None, 1),
    (11, prose(9000, 5), "en", "a", 1),
    (12, "spam spam spam spam spam spam spam spam spam spam spam spam", "en", "a", 1),
    (13, "ü é x\x85y " + prose(20, 6), "fr", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    """Columns whose names helpers could have wanted."""
    extra = ("kept", "words", "row", "size_", "copies", "shard", "slot", "c", "component", "lines_", "items", "items_", "path_", "SHARD_", "flags_", "t1_")
    return docs.withColumns({c: F.lit(7) for c in extra})


def pairs(rows) -> list:
    return sorted(rows, key=repr)


# 3


def test_quality_base(docs):
    got = pairs((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    want = []
    for doc_id, text, *_ in ROWS:
        w = [x for x in re.split(SPACE, text or "") if x]
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)} if len(wins) < 2000 else _hit(wins)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert got == pairs(want)


def _hit(wins):
    seen = {}
    for i, x in enumerate(wins):
        seen.setdefault(x, []).append(i)
    return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}


def test_quality_rejects_junk_and_keeps_prose(spark):
    rows = [(i, prose(120, 100 + i), "en", "a", 1) for i in range(60)] + [(100, " ".join(w.upper() + "!!" for w in prose(120, 9).split()), "en", "a", 1), (101, " ".join(w + "$$$" for w in prose(120, 8).split()), "en", "a", 1)]
    kept = {r.row.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept[100] and not kept[101] and all(kept[i] for i in range(60))


def test_quality_shapes(none, clash):
    assert quality.judge(none).count() == 0
    out = quality.judge(clash).select("row.*", "kept")
    assert out.count() == len(ROWS)


def test_quality_uses_no_python(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 4


def components_of(rows, n, num, den):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return pairs((rows[i][0], len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(rows)))


def test_jaccard_small(docs):
    assert pairs(tuple(r) for r in jaccard.component_ids(docs).collect()) == components_of(ROWS, 3, 9, 10)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_near_copies(spark, n, num, den):
    r, rows = random.Random(n), []
    for k in range(14):
        base = prose(r.choice([9, 12, 20, 60, 150]), 300 + k).split()
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            if r.random() < 0.3:
                w += r.choices(VOCAB, k=r.randint(1, 4))
            rows.append((len(rows), " ".join(w), "en", "a", 1))
    got = pairs(tuple(x) for x in jaccard.component_ids(spark.createDataFrame(rows, SCHEMA), n, num, den).collect())
    assert got == components_of(rows, n, num, den)


def test_jaccard_of_the_pipeline_equals_sql_on_the_tables(spark):
    """Five words and a similarity of 0.8, as the pipeline takes them, on sf0.01."""
    folder, sql = "/root/testdata/sf0.01", jaccard.SQL
    for a, b in (("len(w) >= 3", "len(w) >= 5"), ("len(w) - 1)", "len(w) - 3)"), ("i, i + 2)", "i, i + 4)"), ("shared >= 90 *", "shared >= 80 *")):
        assert a in sql
        sql = sql.replace(a, b)
    got = jaccard.component_ids(spark.read.parquet(f"{folder}/documents.parquet"), 5, 4, 5).toPandas()
    want = database(folder).sql(sql).df()
    assert rows_of(got) == rows_of(want) and (got.component_id != got.doc_id).any()


def test_signature_tree_equals_all_pairs():
    r = np.random.default_rng(3)
    base = [r.integers(0, 1 << 63, 80).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[r.random(80) < 0.97], r.integers(0, 1 << 63, 2).astype(np.uint64)])) for b in base for _ in range(40)]
    tree = jaccard.SignatureTree(sets, 9, 10)
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, j in tree.links():
        up[find(i)] = find(j)
    got = [find(i) for i in range(len(sets))]
    up = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both * 10 >= 9 * (len(sets[i]) + len(sets[j]) - both):
            up[find(i)] = find(j)
    want = [find(i) for i in range(len(sets))]
    assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_jaccard_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    base, rows = prose(150, 77).split(), []
    for i in range(30):
        w = list(base)
        w[5 * i % 150] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 1))
    assert pairs(tuple(x) for x in jaccard.component_ids(spark.createDataFrame(rows, SCHEMA)).collect()) == components_of(rows, 3, 9, 10)


def test_keep_one(docs, none, clash):
    kept = sorted((r.doc_id or -1) for r in jaccard.keep_one(docs).collect())
    assert kept == [-1, -1, 1, 4, 5, 6, 7, 8, 10, 11, 12, 13]
    assert jaccard.keep_one(none).count() == 0 and jaccard.component_ids(none).count() == 0
    assert jaccard.keep_one(clash).columns == clash.columns


# 5


def test_lines(spark, none, clash):
    rows = [(i, f"Common line\nown {i}\n\n common LINE \n{'rare' if i < 9 else 'other'}", "en", "a", 1) for i in range(12)] + [(50, None, None, None, None), (None, "", "en", "a", 0), (None, "common line", "en", "a", 1)]
    out = {(r.doc_id, r.lines_.kept): (r.lines_.n_lines, r.lines_.n_dropped) for r in linededup.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(i, f"own {i}\n\n{'rare' if i < 9 else 'other'}"): (5, 2) for i in range(12)} | {(50, ""): (1, 0), (None, ""): (1, 1)}
    assert {k: v for k, v in out.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert linededup.drop_lines(none).count() == 0
    assert linededup.drop_lines(clash).count() == len(ROWS)


def test_line_runs_compact_and_seal(spark):
    runs = linededup.LineRuns(spark, min_docs=3, fanout=2)
    for k in range(6):
        runs.add(spark.createDataFrame([(x, 0) for x in range(10) if x % 6 <= k], "h1 long, h2 long"))
    count = {x: sum(x % 6 <= k for k in range(6)) for x in range(10)}
    assert sorted(r.h1 for r in runs.frequent().collect()) == [x for x, c in count.items() if c >= 3]
    assert all(len(level) < 2 for level in runs.levels) and runs.sealed
    runs.drop()


@pytest.mark.parametrize("batches", [1, 4, 9, 15])
def test_lines_do_not_depend_on_the_batches(spark, batches):
    r, rows = random.Random(7), []
    for i in range(400):
        own = [f"common line {k}" for k in r.sample(range(60), 4)] + [f"own {i}", "" if i % 3 else "Common Line 1 "]
        rows.append((i, "\n".join(r.sample(own, len(own))), "en", "a", 1))
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    times = {}
    for row in rows:
        for k in {key(x) for x in row[1].split("\n")}:
            times[k] = times.get(k, 0) + 1
    assert sum(9 < n < 60 for k, n in times.items() if k) > 20
    want = {row[0]: "\n".join(x for x in row[1].split("\n") if not key(x) or times[key(x)] < 10) for row in rows}
    before = {t.name for t in spark.catalog.listTables()}
    out = linededup.drop_lines(spark.createDataFrame(rows, SCHEMA), batches=batches)
    assert {x.doc_id: x.lines_.kept for x in out.collect()} == want
    assert {t.name for t in spark.catalog.listTables()} <= before


# 6


def brute_spans(rows, length=100):
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(k)
        spans = len(re.findall(b"\1+", bytes(cover)))
        out.append((doc_id, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return pairs(out)


def test_suffixes(spark, none):
    shared, r = prose(60, 40), random.Random(2)
    rows = [(1, BASE), (2, BASE), (3, None), (4, ""), (5, "ab" * 400), (6, "x" * 99), (7, "x" * 100), (8, "x" * 300), (9, "é" * 120)]
    for i in range(10, 40):
        a = r.randrange(0, 200)
        rows.append((i, prose(r.randint(5, 60), i) + " " + shared[a : a + r.randint(50, 250)] + " " + prose(10, i + 100)))
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = pairs((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.dedup(df).collect())
    assert got == brute_spans(rows)
    assert suffixes.dedup(none).count() == 0


def test_suffixes_of_a_shared_passage_and_a_long_text(spark):
    """One passage in most texts, some of them copies of it alone, a long text of its own repeats, and rows in any order."""
    passage, r = prose(90, 41), random.Random(3)
    rows = [(i, prose(12, 4000 + i) + " " + passage + (" " + prose(8, 5000 + i) if i % 3 else "")) for i in range(150)]
    rows += [(200 + i, passage) for i in range(4)] + [(300, " ".join([prose(300, 42)] * 12)), (301, prose(7000, 43) + passage)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(3)
    want = brute_spans(sorted(rows))
    assert pairs((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.dedup(df).collect()) == want


def test_suffixes_take_null_ids_and_repeats(docs):
    assert suffixes.dedup(docs).count() == len(ROWS)


def test_merged_transforms_give_the_repeated_intervals():
    r = random.Random(4)
    texts = [np.frombuffer(bytes(r.choice(b"ab") for _ in range(n)), np.uint8) for n in (300, 200, 257)]
    suffix, block = suffixes.merge(texts, depth=6)
    rings = [bytes(t) * 2 for t in texts]
    base = np.cumsum([0, 300, 200, 257])
    look = lambda p: (k := int(np.searchsorted(base, p, "right")) - 1, rings[k][p - base[k] : p - base[k] + 6])[1]
    got = [look(int(p)) for p in suffix]
    assert got == sorted(got) and sorted(suffix) == list(range(757))
    assert [b for b, _ in itertools.groupby(block)] == list(range(len(set(got))))
    assert all(len(set(x)) == 1 for x in ([g for g, b in zip(got, block, strict=True) if b == k] for k in set(block)))


# 7


def test_licences_inherit_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/x.txt", "plain words here"),
        ("a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/y.txt", "plain words"),
        ("a/b/z.txt", "All rights reserved.\nother words"),
        ("q/w.txt", "nothing"),
        ("top.txt", None),
        (None, "All rights reserved."),
        ("a/x.txt", "plain words here"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit(1)).drop("licence")
    got = {(r.path, r.own_licence, r.licence, r.granted_by) for r in licenses.licences(df).collect()}
    assert got == {
        ("a/LICENSE", "MIT", "MIT", None), ("a/x.txt", None, "MIT", "a"), ("a/b/LICENSE.md", "Apache-2.0", "Apache-2.0", None), ("a/b/c/y.txt", None, "Apache-2.0", "a/b"),
        ("a/b/z.txt", "Proprietary", "Proprietary", None), ("q/w.txt", None, None, None), ("top.txt", None, None, None), (None, "Proprietary", "Proprietary", None),
    }
    assert licenses.licences(df).count() == len(rows)
    assert licenses.licences(df.limit(0)).count() == 0


# 8


def test_masks_hit_every_window_with_two_replaced_words():
    w = decontaminate.WINDOW
    places = [frozenset(o + i for i in m) for m in decontaminate.MASKS for o in range(w - max(m))]
    assert all(any(not (set(gone) & p) for p in places) for gone in itertools.combinations(range(w), 2))


def brute_items(text, items):
    strip = "!\"'()*,-./:;?[]_`{}"
    norm = lambda t: [x.strip(strip) or x for x in words(t)]
    d, out = norm(text), []
    for i, t in items:
        b = norm(t)
        w = min(13, len(b))
        need = (lambda s: s * 5 >= 4 * w) if w >= 5 else (lambda s: s == w)
        if w and any(need(sum(b[p + k] == d[q + k] for k in range(w))) for p in range(len(b) - w + 1) for q in range(len(d) - w + 1)):
            out.append(i)
    return out


def test_decontamination_equals_brute_force(spark, none, clash, monkeypatch):
    r = random.Random(8)
    items = [(i, prose(r.choice([3, 6, 11, 14, 30]), 500 + i)) for i in range(12)] + [(20, None), (21, ""), (22, prose(30, 500))]
    rows = []
    for i in range(60):
        w = prose(60, 700 + i).split()
        if i % 3:
            b = r.choice(items[:12])[1].split()
            for _ in range(r.randint(0, max(1, len(b) // 5))):
                b[r.randrange(len(b))] = r.choice(VOCAB)
            at = r.randrange(60)
            w[at:at] = b
        rows.append((i, " ".join(w).title() if i % 2 else ", ".join(w), "en", "a", 1))
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (None, items[4][1], "en", "a", 1), (102, prose(30_000, 77) + " " + items[9][1], "en", "a", 1)]
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = pairs((x[0], brute_items(x[1], items)) for x in rows)
    assert pairs((x.doc_id, [i.item_id for i in x["items"]]) for x in decontaminate.search(df, bench, keep=["doc_id"]).collect()) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    small = decontaminate.search(df, bench, keep=["doc_id"], bits=10)  # a filter that lets nearly all pass, and a merge join
    assert pairs((x.doc_id, [i.item_id for i in x["items"]]) for x in small.collect()) == want
    assert decontaminate.search(none, bench).count() == 0
    assert decontaminate.clean(clash, bench.limit(0)).columns == clash.columns
    assert decontaminate.clean(df, bench).count() == sum(not x[1] for x in want)


# 9


def test_longest_first():
    placed = sharding.longest_first([(7, "a"), (5, "b"), (4, "c"), (3, "d"), (1, "e")], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards(docs, none, clash):
    got = sharding.shards(docs, 5).toPandas()
    assert len(got) == len(ROWS) and set(got.law) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {}
    for r in got.itertuples():
        texts.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    assert sharding.shards(none).count() == 0
    assert set(sharding.assign(clash, 3).columns) == set(clash.columns)


def test_shards_equal_a_slow_version(spark):
    """With a bundle for nearly every group, loads are those of longest first over all groups, one heap, done slowly."""
    r = random.Random(4)
    rows = [(i, "x" * r.choice([1, 5, 40, 300, 2000]) + str(r.randrange(60)), "en", "a", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for x in sharding.assign(df, 6, per_shard=4096).collect():
        got.setdefault(x.shard, []).append(len(x.text) + 16)
    groups = {}
    for x in rows:
        groups[x[1]] = groups.get(x[1], 0) + len(x[1]) + 16
    load = [0] * 6
    for size in sorted(groups.values(), reverse=True):
        load[load.index(min(load))] += size
    assert sorted(map(sum, got.values())) == pytest.approx(sorted(load), abs=60)


def test_shards_are_near_equal(spark):
    df = spark.range(3000).select("id", F.expr("repeat('x', cast(id % 97 as int))").alias("t")).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), "t").alias("text"))
    load = sharding.shards(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(load) == 8 and load.max() - load.min() < 200


# 10


def slow_targets(sizes: dict) -> dict:
    """Targets source by source: whoever is above three times its size stops there, and the rest is shared anew."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, found = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}, {}
    while True:
        open_ = [x for x in order if x not in found]
        left, w = sum(sizes.values()) - sum(found.values()), sum(weight[x] for x in open_)
        above = [x for x in open_ if left * weight[x] > 3 * sizes[x] * w]
        if not above:
            return found | {x: left * weight[x] / w for x in open_}
        found |= {x: 3.0 * sizes[x] for x in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 7, "c": 90}, {"a": 0}, {f"s{i:03}": (i * 37) % 101 * (i % 7) for i in range(200)}, {}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_flight_balances():
    r = random.Random(1)
    size = [float(r.randint(1, 900)) for _ in range(4000)]
    p = [0.3] * 4000
    left = mixing.flight(p, list(range(4000)), size, random.Random(2))
    assert len(left) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
    assert abs(sum(p) - 1200) < 1e-3 and abs(sum(x * s for x, s in zip(p, size, strict=True)) - 0.3 * sum(size)) < 1e-3


def test_flight_keeps_probabilities():
    start, hits = [0.5, 0.25, 0.75, 0.5, 0.4, 0.6], np.zeros(6)
    for seed in range(4000):
        p = list(start)
        mixing.flight(p, list(range(6)), [3.0, 5.0, 2.0, 2.0, 9.0, 0.0], random.Random(seed))
        hits += p
    assert np.allclose(hits / 4000, start, atol=0.03)


def test_landing_comes_near_whatever_the_sizes():
    for seed in range(200):
        r = random.Random(seed)
        size = sorted((float(int(r.lognormvariate(5, 1.5))) for _ in range(r.choice([1, 2, 4, 12, 50, 900]))), reverse=True)
        p = [r.choice([0.37, r.random()]) for _ in size]
        want = sum(x * s for x, s in zip(p, size, strict=True))
        mixing.landed(p, size, r, [0.0] * len(size), [3.0] * len(size))
        assert set(p) <= {0.0, 1.0, 2.0, 3.0}
        gap = abs(sum(x * s for x, s in zip(p, size, strict=True)) - want)
        assert gap <= max(min(size), 0.01 * want) or len(size) < 12 and gap <= max(size) / 2


@pytest.mark.parametrize("sf_", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_source_comes_near_its_target(spark, sf_):
    """Within 1 %, or the smallest document of the source."""
    got = mixing.mixture(documents(spark, f"/root/testdata/{sf_}", "doc_id", "source", "text"))
    of = spark.read.parquet(f"/root/testdata/{sf_}/documents.parquet").select("doc_id", "source")
    by = got.join(of, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    rows = by.collect()
    assert len(rows) == 20
    for r in rows:
        assert abs(r.taken - r.target) <= max(0.01 * r.target, r.least), r


def test_mixture(docs, none, clash, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)
    got = mixing.mixture(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 3 * got["size"]).all()
    again = mixing.mixture(docs.repartition(5)).toPandas()
    order = ["doc_id", "size", "taken", "target"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    assert mixing.mixture(none).count() == 0
    assert mixing.mix(clash).count() == len(ROWS)


def test_mixture_of_repeated_rows_comes_near_its_targets(spark):
    """One source has 500 equal rows, one has rows without words; every source's total is held against the slow targets."""
    r, rows = random.Random(12), [(7, "a", "w " * 37)] * 500 + [(None, None, "x y")] * 9 + [(1, "d", None), (2, "d", "")]
    rows += [(100 + i, r.choice("abc"), "w " * r.choice([1, 3, 20, 60, 200])) for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, s, t in rows], SCHEMA)
    got = mixing.mixture(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    taken = {}
    for row in mixing.mix(df).collect():
        taken[row.source] = taken.get(row.source, 0) + row.copies * len((row.text or "").split())
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(3, 0.01 * goal), (s, taken[s], goal)
    order = ["doc_id", "size", "taken", "target"]
    again = mixing.mixture(df.repartition(7)).toPandas()
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    assert sum(got.taken) == sum(taken.values())


# 1


def test_lm_base(docs, none):
    got = pairs((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs).collect())
    tok = [words(t) + [None] for _, t, *_ in ROWS]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in ROWS]
    count = {}
    for t, h in zip(tok, held, strict=True):
        for w in t if not h else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = [(i[0], h, len(t), sum(w in count for w in t), n, round(float(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t)), 6)) for i, t, h in zip(ROWS, tok, held, strict=True)]
    assert got == pairs(want)
    assert lm.score(none).count() == 0


def test_lm_tail_join(docs, monkeypatch):
    full = pairs((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "HEAD", 150)
    assert pairs((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.score(docs).collect()) == full


def test_lm_probabilities_sum_to_one_and_reruns_agree(spark):
    """score() of "a b w" less that of "a b", for every known word w and one unknown one of each class, after some histories:
    their probabilities and that of the end sum to 1."""
    train = [(i, prose(60, 8000 + i), "en", "a", 1) for i in range(60)]
    known = sorted({w for _, t, *_ in train for w in t.split()})
    counts = spark.createDataFrame(train, SCHEMA)
    head, model = lm.fit(counts.select("text"), 1)
    tokens = [list(x) for x in lm.sequences(pa.array([" ".join(known)]))][0]
    _, _, _, h, tail = tokens
    rank = head.words.find(h)
    assert (rank >= 0).sum() >= len(known) - 1
    cls = head.classes(rank, tail)
    share = np.where(rank >= 0, (head.counts[np.maximum(rank, 0)] + 1.0), 0) / 10 ** head.log_class[cls]
    unknown = 1.0 / 10 ** head.log_class  # each class has one slot for all words that it doesn't know
    unknown[: lm.OWN] = 0
    for first, second in ((0, 1), (5, lm.N_FEATURE - 1), (lm.N_FEATURE - 1, lm.N_FEATURE - 1)):
        p = 10 ** model.log10(np.arange(lm.OWN + lm.SURFACE, dtype=np.int32), np.full(256, first, np.int32), np.full(256, second, np.int32))
        assert p.sum() == pytest.approx(1, abs=1e-4)
        empty = p[sorted(set(range(lm.OWN)) - set(cls.tolist()))].sum()  # classes of their own that no word has taken
        assert (p[cls] * share).sum() + (p * unknown).sum() == pytest.approx(1 - empty, abs=1e-4)
    docs = spark.createDataFrame([*train, *ROWS], SCHEMA)
    scores = lambda df: pairs((r.doc_id, round(r.score, 6)) for r in lm.score(df).collect())
    assert scores(docs.coalesce(1)) == scores(docs.coalesce(1))


def test_lm_scores_texts_that_occur_twice_apart(spark):
    """Texts of new words' orders: those that training has elsewhere score higher by the token than those it has once."""
    texts = {i: prose(150, 9000 + i) for i in range(60)}
    rows = [(i, t, "en", "a", 1) for i, t in texts.items()] + [(1000 + i, texts[i], "en", "a", 1) for i in range(20)]
    got = lm.score(spark.createDataFrame(rows, SCHEMA)).toPandas()
    got["each"] = got.score / got.n_tokens
    train = {r.doc_id for r in got.itertuples() if not r.held_out}
    twice = got.doc_id.map(lambda d: (d % 1000 < 20) and (d + 1000 if d < 1000 else d - 1000) in train)
    assert twice.sum() > 20 and got.each[twice].min() > got.each[~twice].max()


def test_lm_followers_keep_probabilities(spark):
    """Of every history, q times the gain summed over all words is 1: over those that followed it, and the rest of q."""
    r = random.Random(3)
    rows = []
    for rid in range(200):
        before = [r.randrange(6) for _ in range(4)]
        word = [r.randrange(5) for _ in before]
        rows.append((rid, rid % 5 == 0, before, word, [float(np.log10(0.02 * (w + 1) + 0.01 * b)) for b, w in zip(before, word, strict=True)]))
    df = spark.createDataFrame(rows, "rid long, held_out boolean, before array<long>, word array<long>, q array<float>")
    gain = {}
    for x in lm.followed(df).collect():
        gain[x.rid] = gain.get(x.rid, 0.0) + x.logs
    count = {}
    for _, held, before, word, _ in rows:
        for k in zip(before, word, strict=True):
            count[k] = count.get(k, 0) + (not held)
    q = lambda b, w: 0.02 * (w + 1) + 0.01 * b

    def total(weight):
        """Of each text, the gains by brute force."""
        out = {}
        for rid, held, before, word, _ in rows:
            for b, w in zip(before, word, strict=True):
                c = {x: count.get((b, x), 0) - (not held and x == w) for x in range(5)}
                s = sum(q(b, x) for x in c if c[x] > 0)
                z = 1 + np.expm1(weight) * s
                out[rid] = out.get(rid, 0.0) + (weight / np.log(10) if c[w] > 0 else 0.0) - np.log10(z)
                assert sum(q(b, x) * (np.exp(weight) if c[x] > 0 else 1) / z for x in range(5)) + (1 - sum(q(b, x) for x in range(5))) / z == pytest.approx(1)
        return out

    best = max(np.linspace(0, 8, 401), key=lambda x: sum(v for rid, v in total(x).items() if rid % 5))
    want = total(best)
    assert all(gain.get(rid, 0.0) == pytest.approx(want[rid], abs=0.02) for rid in want)


def test_maxent_learns_what_follows():
    r = np.random.default_rng(0)
    first = r.integers(0, 50, 60_000).astype(np.int32)
    cls = ((first * 7 + r.integers(0, 2, 60_000)) % 256).astype(np.int32)
    t = lm.Trainer(lm.MaxEnt())
    for a in range(0, 60_000, 2000):
        t.learn(cls[a : a + 2000], first[a : a + 2000], np.zeros(2000, np.int32))
    assert t.model.log10(cls, first, np.zeros(60_000, np.int32))[-5000:].mean() > -0.5
    rows = lm.MaxEnt.rows(np.arange(256, dtype=np.int32), np.full(256, 3, np.int32), np.zeros(256, np.int32))
    assert (10 ** t.model.log10(np.arange(256, dtype=np.int32), np.full(256, 3, np.int32), np.zeros(256, np.int32))).sum() == pytest.approx(1, abs=1e-4) and rows


# 2


def test_toxicity_gradient():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    net.p["word"][:] = r.standard_normal(net.p["word"].shape) * 0.3
    net.p["piece"][:] = r.standard_normal(net.p["piece"].shape) * 0.1
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.Types(*kernels.utf8(pa.array(["one two three four", "five six"])))
    first, length, y = np.array([0, 4]), np.array([4, 2]), np.array([1.0, 0.0])
    kept = {}

    class Catch:
        def step(self, p, grad, tables):
            kept.update(grad)

    class Shown:
        def random(self, shape):
            return np.zeros(shape)

    net.learn(t, first, length, y, np.ones(2), Catch(), Shown())

    def loss():
        x = net.logits(t, first, length).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, x, -x)))))

    for k in ("uf", "xb", "att", "out", "cf", "bias"):
        i = np.unravel_index(np.argmax(np.abs(kept[k])), kept[k].shape)
        net.p[k][i] += 1e-3
        up = loss()
        net.p[k][i] -= 2e-3
        down = loss()
        net.p[k][i] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(kept[k][i], rel=0.05, abs=2e-4), k


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_toxicity_learns_and_scores_whole_texts(spark, none, seed):
    bad = [f"zork{x}" for x in ("a", "en", "ist")]
    r, rows, labels = random.Random(seed), [], []
    for i in range(400):
        w = prose(r.randint(1, 150), 900 * seed + i).split()
        toxic = i % 4 == 0
        if toxic:
            w.insert(r.randrange(len(w) + 1), r.choice(bad))
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, int(toxic)))
    rows += [(1000, prose(3000, 1) + " zorken", "en", "a", 1), (1001, None, None, None, None), (1002, "", "en", "a", 0)]
    out = toxicity.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    truth = {i: int(v) for i, v in labels}
    held = [i for i in truth if out.held_out[i]]
    assert np.mean([out.predicted[i] == truth[i] for i in held]) > 0.95
    assert out.predicted[1000] == 1  # the last of 3,001 words
    assert out.score[1001] == out.score[1002] and 0 <= out.score[1001] <= 1
    assert toxicity.score(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_on_the_tables(spark):
    """Held-out accuracy with few labels: sf0.01 has 45 labelled rows with label 1 to learn from."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), labels.select("doc_id", "toxic")).toPandas()
    held = out[out.held_out].merge(labels.select("doc_id", "toxic").toPandas().dropna(), on="doc_id")
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.toxic == 1).sum() >= 0.5 and hit / (held.predicted == 1).sum() >= 0.5


def test_windows_cover_every_word():
    rows = np.repeat([0, 1, 3], [1, 500, 64])
    row, first, length = toxicity.windows(rows, 4)
    seen = set()
    for f, n in zip(first, length, strict=True):
        seen |= set(range(f, f + n))
    assert seen == set(range(len(rows))) and 2 not in row


# kernels


def test_words_and_hashes():
    texts = ["A bé\x0bc", None, "", "  ", "a", "BÉ"]
    body, at = kernels.utf8(pa.array(texts))
    starts, ends, rows = kernels.word_bounds(body, at)
    assert [(r, bytes(body[s:e]).decode()) for s, e, r in zip(starts, ends, rows, strict=True)] == [(0, "A"), (0, "bé"), (0, "c"), (4, "a"), (5, "BÉ")]
    h = kernels.span_hashes(body, starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 4


def test_hash_index():
    keys = np.unique(kernels.mix(np.arange(5000, dtype=np.uint64)))
    index = kernels.HashIndex(keys)
    assert (index.find(keys) == np.arange(5000)).all() and (index.find(kernels.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
