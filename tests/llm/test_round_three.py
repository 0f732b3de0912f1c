"""Hard negatives, BPE and the Merkle manifest against slow versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstead.llm import bpe, merkle, negatives, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_negatives(rows):
    v = [(i, (x + 1) % 10 if i % 7 == 0 else x, [math.floor(256 * c) for c in e]) for i, x, e in rows if None not in (i, x, e) and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for at, (i, x, q) in enumerate(v):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), j, y) for k, (j, y, r) in enumerate(v) if k != at]
        for s, p, _ in sorted(z for z in scored if z[2] == x)[:5]:
            fits = sorted(z for z in scored if z[2] != x and 30 * -s <= 100 * -z[0] <= 90 * -s)[:10]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "hot", "wide", "odd"])
def test_hard_negatives_equal_a_slow_version(spark, case, monkeypatch):
    r = np.random.default_rng(5)
    n, d = 700, {"plain": 24, "hot": 16, "wide": 8, "odd": 13}[case]
    x = r.normal(size=(n, d)) * {"plain": 0.2, "hot": 0.3, "wide": 3e4, "odd": 0.2}[case]
    vectors = [[float(np.float32(c)) for c in row] for row in x]
    if case == "wide":  # few rows are wide, most have small components
        vectors = [v if i % 50 == 3 else [c / 1e5 for c in v] for i, v in enumerate(vectors)]
    if case == "hot":  # a third of all rows is one vector, and every second row of the rest has a copy
        vectors = [vectors[0] if i % 3 == 1 else vectors[i - i % 2] for i in range(n)]
    rows = [(int(i), int(r.integers(0, 4 if case != "odd" else 10)), v) for i, v in zip(r.permutation(n) * 3 % 2100, vectors)]
    if case == "odd":
        rows += [(None, 1, vectors[0]), (300, None, vectors[1]), (2200, 2, None), (2300, 3, [float("nan")] * d), (2400, 1, [0.5, None]), (2500, 2, [float("inf")]), (2600, 3, []), (2700, 1, [0.25, 0.5])]
        rows += rows[:40] + [(i, -3, v) for i, _, v in rows[40:60] if i % 7]  # repeated rows, ids of two rows, labels below zero
    monkeypatch.setattr(negatives, "CANDIDATES", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"row": F.lit(1), "planes": F.lit("x"), "q": F.lit(2), "v": F.lit(3)})
    got = sorted(tuple(x) for x in negatives.hard_negatives(df).collect())
    assert got == slow_negatives(rows) and len(got) > 100


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0]), (200, 1, [])], schema)).count() == 0
    with pytest.raises(ValueError, match="do not fit"):
        negatives.hard_negatives(spark.createDataFrame([(100, 1, [3e38] * 8), (1, 1, [-3e38] * 8)], schema))


def test_subset_sums_and_planes_are_exact():
    r = np.random.default_rng(1)
    q, a = r.integers(-128, 128, (50, 16)), r.integers(-900, 900, (7, 16))
    planes = negatives.packed(q, 8)
    assert (negatives.unpacked(planes) == q).all()
    assert (negatives.scores(negatives.subset_sums(a, np.int16), planes, np.int32) == q @ a.T).all()


def texts_of_all_kinds():
    r = random.Random(11)
    pools = ["abc etaoin", "  \n\t\r\v\f\x1c\x85\xa0 　", "'s't're've'm'll'd'S'", "äöüßéñ", "語日本中文", "0123456789²½٣", "!?.,;:--…“”", "🙂👍🏽‍️", "\x00\x01\x7f̀́", "<|endoftext|>"]
    out = ["", " ", "\n", "<|endoftext|>", "a<|endoftext|>  b", " <|endoftext|><|endoftext|> x", "<|endoftext", "don't we'll I'm", "a  b   c \n\n d", "x" * 3000, "ab" * 2500, " " * 500 + "q", "aaaaaaab" * 40]
    for _ in range(400):
        out.append("".join(r.choice(r.choice(pools)) if r.random() < 0.95 else "<|endoftext|>" for _ in range(r.randint(1, 60))))
    for _ in range(150):
        out.append("".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x370, 0x1FFF), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(40)))
    return out


def test_bpe_equals_the_library(spark):
    texts = [*texts_of_all_kinds(), None]
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("ids", F.lit(1)).repartition(3)
    ids = F.col("found")
    df = df.withColumn("found", bpe.encode(F.col("text"), PATH))
    rows = df.select("n", "ids", ids, bpe.ids_array(ids).alias("each"), bpe.n_tokens(ids).alias("k"), bpe.decode(ids, PATH).alias("back")).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = t.encode(texts[x.n] or "", add_special_tokens=False).ids
        assert np.frombuffer(x.found, "<u4").tolist() == want == x.each and x.k == len(want), texts[x.n]
        assert x.back == t.decode(want, skip_special_tokens=False)


def test_bpe_in_small_slices_and_of_odd_ids(spark, monkeypatch):
    t = Tokenizer.from_file(PATH)
    texts = texts_of_all_kinds()
    for name, most in (("SLICE", 50), ("INDEXED", 20), ("REMEMBERED", 30), ("REMEMBERED_BYTES", 3)):
        monkeypatch.setattr(bpe, name, most)
    v = bpe.Vocabulary(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    r = random.Random(2)
    for _ in range(200):  # ids whose bytes are no UTF-8
        ids = [r.randrange(50257) if r.random() < 0.5 else r.randrange(256) for _ in range(12)]
        assert v.decode(np.asarray(ids, "<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)
    empty = spark.createDataFrame([], "text string")
    assert empty.select(bpe.decode(bpe.encode(F.col("text"), PATH), PATH)).count() == 0
    assert spark.range(1).select(bpe.decode(F.lit(None).cast("binary"), PATH)).first()[0] == ""


def test_bpe_on_the_table(spark, sf):
    t = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for x in queries.op12_bpe(spark, sf).collect():
        ids = t.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def slow_tree(nodes):
    """The root and each leaf's [(before, after)]."""
    up, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place - place % 3 : place - place % 3 + 3]
            up[k].append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
        at, level = [p // 3 for p in at], [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], up


def slow_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text) rows: the contract's columns."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, slow_leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, higher = slow_tree([trees[s][0] for s in sources])
    out = []
    for s, high in zip(sources, higher):
        for (_, _, leaf, (doc_id, source, lang, n_chars, text)), low in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            even = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 2 == 0
            x = slow_leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if even and text is not None else text)
            for b, a in low + high:
                x = h(b, x, a)
            out.append((doc_id, leaf, trees[s][0], root, h(*[p for step in low + high for p in step]), x, x == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(df, levels=merkle.LEVELS):
    return sorted((tuple(x) for x in merkle.proven(df, levels).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28, 400])
def test_manifest_equals_a_slow_version(spark, n):
    r = random.Random(n)
    rows = [(i * 7 % 1009, r.choice(["a", "a", "a", "b", "é", "", None]), r.choice(["en", None]), r.choice([1, None]), r.choice(["x\ny", "", None, "é\n" * 50])) for i in range(n)]
    rows += [(None, "a", None, None, None)] * (n % 3) + rows[: n // 4] + [(5, "hot", "en", 1, "same\n")] * (n // 2)  # null ids, copies, one row very often
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "leaf": F.lit(2), "up": F.lit(3), "place": F.lit(4)}).repartition(3)
    assert manifest_rows(df, 2) == slow_manifest(rows)


def test_manifest_on_the_table_and_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert manifest_rows(docs) == slow_manifest(rows)
    found = manifest_rows(docs)
    assert {x[6] for x in found} == {True, False}
    assert manifest_rows(docs.limit(0)) == []


@pytest.mark.parametrize("n", [1, 3, 8, 26, 27])
def test_witnesses_grow_with_each_append(n):
    """After any number of appends, closing gives the tree over what came so far."""
    w = merkle.Witnesses(3)
    nodes = [h(str(i)) for i in range(n)]
    for x in nodes:
        w.append(x)
    root = w.close(merkle.height(n))
    assert (root, w.witness) == slow_tree(nodes)


def test_lm_runs_bring_equal_histories_together():
    """Each history of the texts arrives once, in one bucket, in a few bytes; lists of hashes and probabilities took 20 for a position."""
    import numpy as np
    import pyarrow as pa

    from loomstead.llm import kernels as kn
    from loomstead.llm import lm

    r = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{min(int(x), 5000)}" for x in r.zipf(1.4, 400)) for _ in range(60)] + [None, "one two"])
    (_, hi, row, h, tail), = lm.sequences(texts)
    words, times = np.unique(h, return_counts=True)
    known = words[times > 1]
    rank = kn.HashIndex(known).find(h)
    runs = lm.Runs(4)
    runs.add(np.arange(hi) * 7, np.arange(hi) % 5 == 0, row, h, rank, tail)
    got, seen, shipped = [], [], 0
    for bucket, size, data in runs.blocks():
        code, length, docs, rid, held, strange, _ = lm._thick(size, data)
        shipped += len(data)
        hashes = np.where(code < lm.HEAD, known[np.minimum(code, len(known) - 1)], strange[np.maximum(code.astype(np.int64) - lm.HEAD, 0)])
        run = np.repeat(np.arange(len(length)), length)
        at, before = lm.kept_histories(run, hashes, code < lm.HEAD)
        rid = np.repeat(np.cumsum(rid), docs)[run[at]]
        assert (np.repeat(held, docs)[run[at]] == (rid // 7 % 5 == 0)).all()
        got += zip(rid.tolist(), before.tolist(), hashes[at].tolist(), strict=True)
        seen.append(set(before.tolist()))
    at, before = lm.kept_histories(row, h, rank >= 0)
    assert sorted(got) == sorted(zip((row[at] * 7).tolist(), before.tolist(), h[at].tolist(), strict=True))
    assert sum(map(len, seen)) == len(set.union(*seen)) and shipped < 12 * len(at)
