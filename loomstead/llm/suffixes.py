"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

A 100-byte string is judged at its anchor: the place of the least hash of 8 bytes among its first 64 places. Equal
strings have equal anchors, 37 bytes or more before their ends, so strings can only repeat where those 37 bytes do.
1. Anchors are dealt by a hash of their 37 bytes, packed; those that two places share are kept.
2. Each kept anchor gives its context: the bytes of all 100-byte strings that have it as anchor. Of equal contexts all but
   the earliest repeat whole: a task sends on only those that no earlier one of its own equals, so that a passage which very
   many texts share reaches the next task at most some times for each task. Contexts are dealt and sorted by the same
   hash, so all equal strings meet in a task, and equal ones are settled there again. A context that is then alone under its
   hash holds no other repeat: its strings have the anchor at different distances.
3. In a task, the distinct contexts that may hold a repeat (a hash of 100 bytes occurs twice) are cut into shards. Each shard's suffixes are sorted and give its Burrows-Wheeler
   transform. The transforms are merged without sorting suffixes anew: the interleave starts with shard after shard, and
   each round deals it by the symbols of the transforms in their current order (Holt and McMillan). After k rounds the
   interleave is right for prefixes of k bytes, and the block borders carried along part suffixes whose common prefix is
   shorter; they give the common prefixes up to 100 bytes, which is as far as they are needed. Blocks after 100 rounds are the repeated intervals; all but the earliest start of each are repeats.
4. Repeated starts are gathered by text, and bytes they cover are removed.
A text that an earlier document has whole isn't searched: all of it goes, if it has 100 bytes at all.

Defined results: null counts as empty; documents are ordered by doc_id, null last, and for equal ids by a hash of the text;
rows of equal id and text are one document, so they are judged alike; texts under 100 bytes stay; an empty table gives an
empty result; columns of other names stay out of the way. Texts are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import kernels as kn
from loomstead.llm.common import written

LENGTH, GRAM, PLACES = 100, 8, 64
SURE = LENGTH - PLACES + 1
#: Bytes of a shard and of the contexts merged at once, small enough for the arrays of a merge to stay in a core's cache, and bytes
#: of rows that are gathered before they are cut into such chunks.
SHARD, CHUNK, READ = 1 << 15, 1 << 17, 1 << 20
#: Shards of a key that is larger than a chunk: each round looks for the places of every shard.
MOST_SHARDS = 8
LAST = (1 << 63) - 1
#: Distinct contexts that a task remembers (some 200 bytes each), to settle equal ones before the shuffle.
REMEMBERED = 500_000


def anchors(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first start, last start, key) of every anchor; places count from the start of body."""
    n = len(body)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    p, q = kn.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    least = kn.mix((sums[GRAM:] - sums[:-GRAM]) * q[: n - GRAM + 1], 50)
    least = (least & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(least), dtype=np.uint64)
    step = 1
    while step < PLACES:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    counts = np.maximum(0, np.diff(at) - LENGTH + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at[:-1], counts)
    a = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])) if len(a) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(a)) - 1
    key = kn.mix((sums[a[new] + SURE] - sums[a[new]]) * q[a[new]], 51)
    return row[new], a[new], start[new], start[end] if len(new) else start, key


def _keys(bits: int):
    """Packed anchors of the texts that are new to this task: (bucket, keys, texts, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            th = b.column("th").to_numpy()
            for lo, hi, body, at in kn.slices(b.column("text"), 2 * kn.SLICE_BYTES):
                new = np.zeros(hi - lo, bool)
                for i, t in enumerate(th[lo:hi].tolist()):
                    if t not in seen:
                        seen.add(t)
                        new[i] = True
                row, a, _, _, key = anchors(body, at)
                pick = new[row] if len(row) else np.zeros(0, bool)
                row, a, key = row[pick], a[pick] - at[row[pick]], key[pick]
                if not len(row):
                    continue
                bucket = (key >> np.uint64(64 - bits)).astype(np.uint32)
                order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                bucket, k, t, a = bucket[order], (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), th[lo + row[order]], a[order].astype(np.uint32)
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                spans = list(zip(cut, np.append(cut[1:], len(bucket)), strict=True))
                cols = [pa.array(bucket[cut].astype(np.int32)), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (k, t, a))]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "texts", "places"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, places) of the anchors whose key two places have."""
    keys, texts, places = [], [], []
    for b in batches:
        for bucket, k, t, a in zip(b.column("bucket").to_pylist(), b.column("keys"), b.column("texts"), b.column("places"), strict=True):
            keys.append(np.frombuffer(k.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            texts.append(np.frombuffer(t.as_buffer(), np.int64))
            places.append(np.frombuffer(a.as_buffer(), np.uint32))
    if not keys:
        return
    k, t, a = np.concatenate(keys), np.concatenate(texts), np.concatenate(places)
    del keys, texts, places
    order = np.argsort(k)
    k = k[order]
    same = np.concatenate([[False], k[1:] == k[:-1], [False]])
    order = order[same[1:] | same[:-1]]
    k, t, a = k[same[1:] | same[:-1]], t[order], a[order]
    order = np.lexsort((a, t, k))
    k, t, a = k[order], t[order], a[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1])]) if len(k) else np.zeros(0, bool)
    k, t, a = k[new], t[new], a[new]  # copies in other tasks gave the same anchors
    same = np.concatenate([[False], k[1:] == k[:-1], [False]]) if len(k) else np.zeros(1, bool)
    both = same[1:] | same[:-1]
    t, a = t[both], a[both]
    order = np.argsort(t, kind="stable")
    t, a = t[order], a[order]
    cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(t))
    for i in range(0, len(cut), 10_000):
        s = slice(i, i + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(t[cut[s]]), pa.array([a[x:y].tobytes() for x, y in zip(cut[s], ends[s], strict=True)], pa.binary())], ["th", "places"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, th, start, context, whole): kept anchors, each with its context and whole null; those whose context the task
    met before at an earlier place repeat whole, and come as packed runs (first, last) of their text, under a key of the
    text's own. What the task remembers only saves rows: the next step settles what is left."""
    first: dict[int, tuple[int, int, int]] = {}
    for b in batches:
        docs, ths, places = b.column("doc").to_numpy(), b.column("th").to_numpy(), b.column("places")
        for lo, hi, body, at in kn.slices(b.column("text")):
            row, a, begin, last, key = anchors(body, at)
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            keep = np.zeros(len(row), bool)
            for i in range(hi - lo):
                wanted = np.frombuffer(b"".join(places[lo + i].as_py()), np.uint32).astype(np.int64) + at[i]
                keep[edge[i] : edge[i + 1]] = np.isin(a[edge[i] : edge[i + 1]], wanted)
            row, begin, last, key = row[keep], begin[keep], last[keep], key[keep]
            if not len(row):
                continue
            doc, th, start = docs[lo + row], ths[lo + row], (begin - at[row]).astype(np.int32)
            known = kn.span_hashes(body, begin, last + LENGTH, lower=False) ^ kn.mix(key, 51)
            order = np.lexsort((start, th, doc))
            u, place = np.unique(known[order], return_index=True)
            least = order[place]  # the earliest of each context in this slice
            lead = np.zeros(len(row), bool)
            if len(first) + len(u) > REMEMBERED:
                first.clear()
            for h, i, p in zip(u.tolist(), least.tolist(), zip(doc[least].tolist(), th[least].tolist(), start[least].tolist(), strict=True), strict=True):
                if (old := first.get(h)) is None or p < old:
                    first[h] = p
                    lead[i] = True
            rest = np.flatnonzero(~lead)
            if len(rest):
                rest = rest[np.argsort(row[rest], kind="stable")]
                cut = np.flatnonzero(np.concatenate([[True], row[rest][1:] != row[rest][:-1]]))
                runs = np.stack([start[rest], start[rest] + (last - begin)[rest].astype(np.int32)], 1).astype(np.int32)
                packed = [runs[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(rest)), strict=True)]
                own = th[rest[cut]]
                yield _row(kn.mix(own.view(np.uint64), 52).view(np.int64), doc[rest[cut]], own, np.zeros(len(cut), np.int32), None, packed)
            raw, new = body.tobytes(), np.flatnonzero(lead)
            for i in range(0, len(new), 20_000):
                s = new[i : i + 20_000]
                yield _row(key[s].view(np.int64), doc[s], th[s], start[s], [raw[x : y + LENGTH] for x, y in zip(begin[s], last[s], strict=True)], None)


def _row(key: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, context: list[bytes] | None, whole: list[bytes] | None) -> pa.RecordBatch:
    lists = [pa.nulls(len(key), pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (context, whole)]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(th), pa.array(start), *lists], ["key", "doc", "th", "start", "context", "whole"])


def prefixes(text: np.ndarray) -> np.ndarray:
    """The first 8 bytes of every suffix of a text read as a ring, as a number."""
    n = len(text)
    ring = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | ring[k : k + n]
    return key


def transform(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a text read as a ring, and its suffixes in order (of their first bytes, at least depth)."""
    n = len(text)
    key, have = prefixes(text), 8
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        if have >= depth or int(rank.max(initial=0)) == n - 1:
            return text[order - 1], order
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.roll(rank, -(have % n)).astype(np.uint64)
        have *= 2


def merge(shards: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, block) of all suffixes of some shards, in merged order: suffixes (places in the shards laid end to end) of
    one block have their first depth bytes in common. The interleave starts with shard after shard and one block; each
    round deals the shards' numbers by the transforms' symbols in the order so far."""
    sorted_ = [transform(s, depth) for s in shards]
    base = np.cumsum([0, *(len(s) for s in shards)])
    symbols = np.concatenate([b for b, _ in sorted_])
    suffixes = np.concatenate([order + base[i] for i, (_, order) in enumerate(sorted_)])
    n, ids = len(symbols), range(len(shards))
    source = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) > 255 else np.uint8), np.diff(base))
    new = np.zeros(n, bool)  # where a block begins
    place = lambda: np.concatenate([np.flatnonzero(source == i) for i in ids])  # noqa: E731  where each shard's suffixes are
    by_shard = place()
    for round_ in range(depth):
        if round_ % 8 == 0 and np.count_nonzero(new) == n - 1:
            break
        current = np.empty(n, np.uint8)
        current[by_shard] = symbols
        order = np.argsort(current, kind="stable")
        block = np.cumsum(new, dtype=np.int32)[order]
        source, s = source[order], current[order]
        new[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        by_shard = place()
    merged = np.empty(n, np.int64)
    merged[by_shard] = suffixes
    return merged, np.cumsum(new, dtype=np.int32)


def repeats(contexts: list[bytes]) -> list[np.ndarray]:
    """For each of some distinct contexts, earliest first: whether each of its 100-byte strings also starts before. Contexts of which
    no string has the hash of another are not transformed: equal strings have equal hashes, so they hold no repeat."""
    body = np.frombuffer(b"".join(contexts), np.uint8)
    counts = np.array([len(c) for c in contexts]) - LENGTH + 1
    edge = np.cumsum(counts) - counts
    start = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * (LENGTH - 1), counts)
    hashes = kn.span_hashes(body, start, start + LENGTH, lower=False)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    some = np.flatnonzero(np.logical_or.reduceat(twice, edge)) if len(edge) else edge
    out = [np.zeros(n, bool) for n in counts.tolist()]
    for i, found in zip(some.tolist(), _intervals([contexts[i] for i in some.tolist()]) if len(some) else [], strict=True):
        out[i] = found
    return out


def _intervals(contexts: list[bytes]) -> list[np.ndarray]:
    """The same by merging the transforms of shards."""
    length = np.array([len(c) for c in contexts])
    base = np.cumsum([0, *length])
    size = max(SHARD, int(base[-1]) // MOST_SHARDS)
    shards, i = [], 0
    while i < len(contexts):
        j = max(i + 1, int(np.searchsorted(base, base[i] + size, "right")) - 1)
        shards.append(np.frombuffer(b"".join(contexts[i:j]), np.uint8))
        i = j
    suffix, block = merge(shards)
    inside = np.zeros(base[-1], bool)
    inside_end = base[1:] - LENGTH + 1
    mark = np.zeros(base[-1] + 1, np.int32)
    np.add.at(mark, base[:-1], 1)
    np.add.at(mark, inside_end, -1)
    inside = np.cumsum(mark[:-1]) > 0
    use = inside[suffix]
    suffix, block = suffix[use], block[use]
    earliest = np.full(int(block.max(initial=0)) + 1, base[-1], np.int64)
    np.minimum.at(earliest, block, suffix)
    again = np.zeros(base[-1], bool)
    again[suffix] = suffix > earliest[block]
    return [again[x:y] for x, y in zip(base[:-1], inside_end, strict=True)]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, starts): the repeated starts of the contexts of a task, as runs (first, last), packed. Rows come sorted by key,
    then in document order; they are taken in chunks that never part a key."""
    held: list[pa.RecordBatch] = []

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        place = np.stack([rows.column(c).to_numpy() for c in ("key", "doc", "th", "start")], 1)
        rows = rows.filter(pa.array(np.concatenate([[True], (place[1:] != place[:-1]).any(1)])))  # repeated rows are one document
        context = rows.column("context").combine_chunks().dictionary_encode()
        code = context.indices.to_numpy()
        first = np.unique(code, return_index=True)[1]
        distinct = context.dictionary.to_pylist()
        order = np.argsort(first)
        found = {i: np.zeros(len(distinct[i]) - LENGTH + 1, bool) for i in order.tolist()}
        _, group, partners = np.unique(rows.column("key").to_numpy()[first], return_inverse=True, return_counts=True)
        order = order[partners[group][order] > 1]  # strings of a context alone under its key have the anchor at different distances
        if len(order):
            found |= dict(zip(order.tolist(), repeats([distinct[i] for i in order]), strict=True))
        th, start = rows.column("th").to_pylist(), rows.column("start").to_numpy()
        out: dict[int, list[int]] = {}
        for i, c in enumerate(code.tolist()):
            again = found[c]
            if first[c] != i:
                out.setdefault(th[i], []).extend((int(start[i]), int(start[i]) + len(again) - 1))
            elif again.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                edge[1::2] -= 1
                out.setdefault(th[i], []).extend((edge + int(start[i])).tolist())
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([np.array(v, np.int32).tobytes() for v in out.values()], pa.binary())], ["th", "starts"])

    def chunks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Chunks of about CHUNK bytes of contexts that part no key."""
        key = rows.column("key").to_numpy()
        edge = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        held = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column("context")).to_numpy().astype(np.int64))])[edge]
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(held, held[i] + CHUNK, "right")) - 1)
            yield chunk(rows.slice(edge[i], edge[j] - edge[i]))
            i = j

    size, enough = 0, READ
    for b in batches:
        whole = b.filter(pc.is_valid(b.column("whole")))
        if whole.num_rows:
            yield pa.RecordBatch.from_arrays([whole.column("th"), whole.column("whole")], ["th", "starts"])
            b = b.filter(pc.is_null(b.column("whole")))
            if not b.num_rows:
                continue
        held.append(b)
        size += b.nbytes
        if size < enough:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from chunks(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
        size = sum(x.nbytes for x in held)
        enough = READ if cut else 2 * size  # one key so far: look again when there is twice as much, so each row is laid out a few times
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield from chunks(rows)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, again, runs in zip(b.column("text"), b.column("again").to_pylist(), b.column("runs"), strict=True):
            body = text.as_buffer().to_pybytes() if text.is_valid else b""
            if again and len(body) >= LENGTH:
                spans = [(0, len(body))]
            elif runs.is_valid and runs.as_py():
                r = np.frombuffer(b"".join(runs.as_py()), np.int32).reshape(-1, 2).astype(np.int64)
                r = np.unique(r, axis=0)
                end = np.maximum.accumulate(r[:, 1] + LENGTH)
                new = np.flatnonzero(np.concatenate([[True], r[1:, 0] > end[:-1]]))
                spans = list(zip(r[new, 0].tolist(), end[np.append(new[1:], len(r)) - 1].tolist(), strict=True))
            else:
                spans = []
            kept, at = hashlib.sha256(), 0
            for x, y in spans:
                kept.update(body[at:x])
                at = y
            kept.update(body[at:])
            out.append((len(body), sum(y - x for x, y in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
        cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (starts and ends of the removed runs) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), F.xxhash64(text).alias("th"), F.col("text"))
    long_ = rows.filter(F.octet_length("text") >= LENGTH)
    firsts = written(long_.groupBy("th").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.sum(F.octet_length("text").cast("long")).alias("bytes")), "suffix-firsts")
    total = firsts.agg(F.sum("bytes")).first()[0] or 0
    bits = min(24, max(4, int(total / 33 / 500_000).bit_length()))
    packed = long_.select("th", "text").mapInArrow(_keys(bits), "bucket int, keys binary, texts binary, places binary")
    shared = packed.repartition("bucket").mapInArrow(_shared, "th long, places binary").groupBy("th").agg(F.collect_list("places").alias("places"))
    wanted = shared.join(firsts.select("th", F.col("first").alias("doc")).hint("merge"), "th").withColumnsRenamed({"th": "t_", "doc": "d_"})
    wanted = written(wanted, "suffix-anchors")
    found = long_.join(wanted.hint("merge"), (F.col("th") == F.col("t_")) & (F.col("doc") == F.col("d_")))
    found = found.select("doc", "th", "places", "text").mapInArrow(_contexts, "key long, doc long, th long, start int, context binary, whole binary")
    found = found.repartition("key").sortWithinPartitions("key", "doc", "th", "start")
    runs = found.mapInArrow(_repeated, "th long, starts binary").groupBy(F.col("th").alias("r_")).agg(F.collect_list("starts").alias("runs"))
    copies = firsts.filter("first < last").select(F.col("th").alias("c_"), "first")
    marks = written(runs.join(copies.hint("merge"), F.col("r_") == F.col("c_"), "full_outer").select(F.coalesce("r_", "c_").alias("m_"), "runs", "first"), "suffix-runs")
    rows = rows.join(marks.hint("merge"), F.col("th") == F.col("m_"), "left")
    again = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "text", again.alias("again"), "runs")
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
