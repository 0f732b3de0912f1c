"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased (A-Z), with ASCII punctuation stripped at both ends. A fixed mask looks at some of the words in
its span and ignores the others, so a seed still hits where an ignored word was replaced. Seeds of the test items, each
with its item and place, are a table; so are those seeds of the documents that a fixed-size filter over the items' seeds
lets pass, each with the words around it. The two are joined by seed hash. Each hit fixes an alignment, along which the
windows around it are compared word by word. An item is found if, in some window of WINDOW words, at least 80 % of the words
agree. The two masks below hit every window of 13 words with at most 2 replaced (checked in the tests), so looking
around the hits misses no window. Items of fewer than 13 words are one window: their masks are all that ignore a fifth of the
words; items under five words must match whole.

Copies of a text are searched once, by a 128-bit hash of it; neither table passes through the driver, which sees the filter
and the lengths of short items only. Defined results: null or empty texts hold nothing; null items, items with a null id and
items without words are never found; equal items are all reported, an id that repeats once; repeated rows are judged alike; an
empty table gives an empty result; columns of other names stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm import kernels as kn
from loomstead.llm.common import fresh, sized_join, written

#: The window in words, the masks (places looked at) and the share of words that must agree.
WINDOW = 13
MASKS = ((0, 2, 6, 8, 9, 10), (0, 2, 3, 4, 5, 8))
NUM, DEN = 4, 5
#: Bits of the filter that document seeds pass before the join (8 MB in each task, whatever the input), and its segments.
FILTER_BITS, SEGMENTS = 26, 64
#: Seeds of items (some 350 bytes each) up to which they are broadcast after a count; beyond that both sides are merged.
BROADCAST_SEEDS = 100_000
#: Texts with items found, up to which their lists (some tens of bytes for an item) are broadcast after a count.
BROADCAST_TEXTS = 100_000


def tokens(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and byte start of every word; a word of punctuation alone counts whole."""
    starts, ends, rows = kn.word_bounds(body, at)
    s, e = kn.stripped(body, starts, ends)
    return kn.span_hashes(body, s, e), rows, starts


def masks_for(length: int) -> list[tuple[int, ...]]:
    """Masks for items of so many words; those of WINDOW words or more share MASKS."""
    if length >= WINDOW:
        return list(MASKS)
    off = length // 5
    return [tuple(sorted(set(range(length)) - set(x))) for x in combinations(range(length), off)]


def seed(h: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words that a mask looks at from each place on; masks differ in theirs."""
    s = np.full(len(at), np.uint64(len(mask)))
    for o in mask:
        s = kn.mix(s ^ kn.mix(h[at + o], o + 100), 20)
    return s


def _places(rows: np.ndarray, span: int) -> np.ndarray:
    """Places from which span more words are in the same text."""
    if len(rows) <= span:
        return np.zeros(0, np.int64)
    return np.flatnonzero(rows[: len(rows) - span] == rows[span:])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item_id, place, words): every seed of every item, and the hashes of the item's words around it."""
    for b in batches:
        for lo, hi, body, at in kn.slices(b.column("text")):
            h, rows, _ = tokens(body, at)
            ids, edge = b.column("item_id").slice(lo, hi - lo), np.searchsorted(rows, np.arange(hi - lo + 1))
            lengths = np.diff(edge)
            for n in np.unique(lengths[lengths > 0]).tolist():
                masks = masks_for(n)
                for mask in masks:
                    p = np.concatenate([np.arange(edge[i], edge[i + 1] - mask[-1]) for i in np.flatnonzero(lengths == n)])
                    yield _rows(seed(h, p, mask), {"item_id": ids.take(pa.array(rows[p]))}, p, h, edge, rows, n)


def _rows(found: np.ndarray, named: dict[str, pa.Array], p: np.ndarray, h: np.ndarray, edge: np.ndarray, rows: np.ndarray, n: int) -> pa.RecordBatch:
    """Seeds with their place in the text, where the words around them begin, and those words' hashes (8 bytes each)."""
    span = min(n, WINDOW)
    first, last = np.maximum(edge[rows[p]], p - span + 1), np.minimum(edge[rows[p] + 1], p + 2 * span)
    around = pa.array([h[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
    cols = [pa.array(found.view(np.int64)), *named.values(), pa.array((p - edge[rows[p]]).astype(np.int32)), pa.array((p - first).astype(np.int32)), pa.array(np.full(len(p), n, np.int32)), around]
    return pa.RecordBatch.from_arrays(cols, ["seed", *named, "place", "back", "n", "around"])


def _segments(bits: int):
    """(segment, part) of the filter of so many bits (a power of two), of the seeds of a task."""
    size = (1 << bits) // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for k in np.unique(bit // np.uint64(size)).tolist():
                inside = (bit[bit // np.uint64(size) == k] % np.uint64(size)).astype(np.int64)
                np.bitwise_or.at(parts.setdefault(int(k), np.zeros(size // 8, np.uint8)), inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for k, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "part"])

    return run


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter over all seeds: SEGMENTS rows of fixed size come to the driver."""
    segment = (F.shiftrightunsigned("seed", 64 - bits) / ((1 << bits) // SEGMENTS)).cast("int")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = len(out) // SEGMENTS
    for r in seeds.select("seed").repartition(SEGMENTS, segment).mapInArrow(_segments(bits), "segment int, part binary").collect():
        out[r.segment * size : (r.segment + 1) * size] |= np.frombuffer(r.part, np.uint8)
    return out


def _document_seeds(masks: list[tuple[int, tuple[int, ...]]], shared: Any, bits: int):
    """(seed, t1, t2, place, back, n, around) of the seeds that the filter lets pass; a text that the task had is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for b in batches:
            t1 = b.column("t1").to_numpy()
            for lo, hi, body, at in kn.slices(b.column("text")):
                h, rows, _ = tokens(body, at)
                new = np.zeros(hi - lo, bool)
                for i, t in enumerate(t1[lo:hi].tolist()):
                    if t not in seen:
                        seen.add(t)
                        new[i] = True
                edge = np.searchsorted(rows, np.arange(hi - lo + 1))
                named = {c: b.column(c).slice(lo, hi - lo) for c in ("t1", "t2")}
                for n, mask in masks:
                    p = _places(rows, mask[-1])
                    p = p[new[rows[p]]]
                    s = seed(h, p, mask)
                    bit = s >> np.uint64(64 - bits)
                    hit = np.flatnonzero(known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    for i in range(0, len(hit), 20_000):
                        q = hit[i : i + 20_000]
                        yield _rows(s[q], {c: x.take(pa.array(rows[p[q]])) for c, x in named.items()}, p[q], h, edge, rows, n)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, item_id, agree, first_word, last_word) of each hit around which a window holds."""
    for b in batches:
        out: list[tuple[int, int, int, int]] = []
        cols = (b.column(c).to_pylist() for c in ("i_back", "i_around", "n", "place", "back", "around"))
        for k, (i_back, item, n, place, back, doc) in enumerate(zip(*cols, strict=True)):
            x, y, w = np.frombuffer(item, np.uint64), np.frombuffer(doc, np.uint64), min(n, WINDOW)
            left, right = min(i_back, back), min(len(x) - i_back, len(y) - back)
            if left + right < w:
                continue
            same = np.concatenate([[0], np.cumsum(x[i_back - left : i_back + right] == y[back - left : back + right])])
            score = same[w:] - same[:-w]
            hold = np.flatnonzero(score * DEN >= NUM * w if w >= 5 else score == w)
            if len(hold):
                out.append((k, int(score.max()), place - left + int(hold[0]), place - left + int(hold[-1]) + w - 1))
        at = pa.array([o[0] for o in out], pa.int64())
        found = [pa.array([o[i] for o in out], pa.int32()) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("t1", "t2", "item_id")), *found], ["t1", "t2", "item_id", "agree", "first_word", "last_word"])


def found_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """(t1, t2, items): the test items found in each text that holds any; texts are known by two 64-bit hashes."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    seeds = written(items.mapInArrow(_item_seeds, "seed long, item_id long, place int, back int, n int, around binary").dropDuplicates(["seed", "item_id", "place", "n", "around"]), "bench-seeds")
    lengths = [r[0] for r in seeds.select(F.least("n", F.lit(WINDOW))).distinct().collect()]  # WINDOW rows at most
    masks = [(n, mask) for n in sorted(lengths) for mask in masks_for(n)]
    texts = docs.select(*text_key(text), F.col(text).alias("text")).filter("text IS NOT NULL")
    scanned = texts.mapInArrow(_document_seeds(masks, sc.broadcast(_filter(seeds, bits)), bits), "seed long, t1 long, t2 long, place int, back int, n int, around binary")
    scanned = written(scanned, "document-seeds")
    right = seeds.select(F.col("seed").alias("s_"), "item_id", F.col("back").alias("i_back"), F.col("around").alias("i_around"), F.col("n").alias("i_n"))
    hits = sized_join(scanned.drop("n"), right, F.col("seed") == F.col("s_"), "inner", limit=BROADCAST_SEEDS).withColumnRenamed("i_n", "n")
    held = hits.select("t1", "t2", "item_id", "place", "back", "around", "i_back", "i_around", "n").mapInArrow(_verify, "t1 long, t2 long, item_id long, agree int, first_word int, last_word int")
    each = held.groupBy("t1", "t2", "item_id").agg(F.max("agree").alias("agree"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    lists = each.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("item_id", "agree", "first_word", "last_word"))).alias("items"))
    return written(lists, "contaminated")


def text_key(text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2")


FOUND = "array<struct<item_id: bigint, agree: int, first_word: int, last_word: int>>"


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """The columns `keep` of docs (all, if None) with `items`: an array of the test items found, each with the words that
    agree in its best window, and the first and last word (from 0) of the windows that hold."""
    keep = docs.columns if keep is None else keep
    k1, k2, out = fresh(docs, "k1_", "k2_", "items_")
    lists = found_items(docs, benchmark, text, bits).toDF(k1, k2, out)
    t1, t2 = text_key(text)
    rows = sized_join(docs, lists, (t1 == F.col(k1)) & (t2 == F.col(k2)), "left", limit=BROADCAST_TEXTS)
    items = F.coalesce(F.col(out), F.array().cast(FOUND))
    return rows.select(*[F.col(f"`{c}`") for c in keep], items.alias(out)).toDF(*keep, "items")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows in which a test item was found."""
    k1, k2 = fresh(docs, "k1_", "k2_")
    lists = found_items(docs, benchmark, text).select(F.col("t1").alias(k1), F.col("t2").alias(k2))
    t1, t2 = text_key(text)
    return sized_join(docs, lists, (t1 == F.col(k1)) & (t2 == F.col(k2)), "left_anti")
