"""Language-model scoring by a hashed maximum-entropy model.

A word's probability is that of its class given the words before it, times its share of the class. There are 256
classes in 16 groups: the commonest words have a class each, all others are classed by a hash of their last bytes. Group
and class within the group are two softmaxes over hashed features: the word before, the one before that (skip), and the
two together. Each task trains on its share of the training texts by AdaGrad on minibatches; the tasks' weights are
averaged feature by feature, weighted by how often each feature was seen; `rounds` such passes are made. Shares in a
class come from counts over all training texts, add-one smoothed, with one slot for all unknown words of the class, so
the probabilities of all words sum to 1 after any history.

One more feature grows with the corpus: whether a word followed the same ORDER - 1 words elsewhere in the training texts. It
has one weight, and all histories of all training texts are kept: with q the probability so far and S
its sum over all words that followed a history, a word that did has q e^weight / (1 + (e^weight - 1) S), any other
q / (1 + (e^weight - 1) S), which sums to 1 again. A training text's own occurrence is left out, so texts that occur once
are scored as if unseen. Runs of tokens are shuffled to where equal histories meet, and only
positions whose history training has elsewhere go on from there; the weight is where the likelihood of all training
positions has no gradient, found on a histogram of S.

The counts of the HEAD commonest words and the other weights (some 7 MB) have a fixed size and go to every task. All other
words meet their counts in a join, and are not among those that a history is kept for. Words are known by 64-bit hashes.

Defined results: null text is empty, so it has the end token alone; rows with a null id are in the fold of the empty
text (crc32 0); repeated rows count as often as they occur; without training texts all words are unknown; an empty
table gives an empty result; columns of other names stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import kernels as kn
from loomstead.llm.common import commonest, in_fold, written

HEAD = 1 << 17
OWN, SURFACE, GROUP = 96, 160, 16
#: Feature ids: the commonest words, then the classes by ending, then the end (also what stands before a text).
N_WORD, N_FEATURE, N_PAIR = 1887, 2048, 1 << 15
END_HASH = np.uint64(0x9D5C3F1E7A6B2C41)
#: Words in the longest n-gram.
ORDER = 5
MINIBATCH = 1 << 16
RATE = 0.25


def endings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 to SURFACE - 1 for each word: a hash of its last three bytes."""
    low = kn.LOWER[body] if len(body) else body
    h = np.zeros(len(ends), np.uint64)
    for back in (1, 2, 3):
        h = h * np.uint64(257) + np.where(ends - back >= starts, low[np.maximum(ends - back, 0)], 0).astype(np.uint64)
    return (kn.mix(h, 30) % np.uint64(SURFACE)).astype(np.int32)


def sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, hash, ending) of the tokens of each slice: words, and an end after each text (ending -1)."""
    for lo, hi, body, at in kn.slices(texts):
        starts, ends, rows = kn.word_bounds(body, at)
        n = hi - lo
        place = np.arange(len(rows)) + rows
        total = len(rows) + n
        row, h, tail = np.empty(total, np.int64), np.full(total, END_HASH), np.full(total, -1, np.int32)
        row[place], h[place], tail[place] = rows, kn.span_hashes(body, starts, ends), endings(body, starts, ends)
        row[np.cumsum(np.bincount(rows, minlength=n)) + np.arange(n)] = np.arange(n)
        yield lo, hi, row, h, tail


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, ending, c) of the tokens of a task, summed over some slices at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, t, c = h[order], t[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], t[at], np.add.reduceat(c, at)

    def table() -> Iterator[pa.RecordBatch]:
        h, t, c = held[0]
        for i in range(0, len(h), 200_000):
            s = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(t[s]), pa.array(c[s])], ["h", "ending", "c"])

    for b in batches:
        for _, _, _, h, tail in sequences(b.column("text")):
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((u, tail[first], c.astype(np.int64)))
            if len(held) >= 16:
                held[:] = [merged()]
                if len(held[0][0]) > 3_000_000:
                    yield from table()
                    held.clear()
    if held:
        held[:] = [merged()]
        yield from table()


@dataclass
class Head:
    """What every task needs to know of the counts: all of it has a fixed size."""

    words: kn.HashIndex
    counts: np.ndarray
    endings: np.ndarray
    log_total: float
    log_class: np.ndarray

    def classes(self, rank: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Class of each token: its own for the commonest words and the end, else by ending."""
        return np.where(tail < 0, OWN - 1, np.where((rank >= 0) & (rank < OWN - 1), rank, OWN + tail)).astype(np.int32)

    def features(self, rank: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.where(tail < 0, N_FEATURE - 1, np.where((rank >= 0) & (rank < N_WORD), rank, N_WORD + tail)).astype(np.int32)


def history(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the token before each token and of the one before that; the end stands before a text."""
    first = np.full(len(row), N_FEATURE - 1, np.int32)
    second = first.copy()
    first[1:] = np.where(row[1:] == row[:-1], feature[:-1], N_FEATURE - 1)
    second[2:] = np.where(row[2:] == row[:-2], feature[:-2], N_FEATURE - 1)
    return first, second


class MaxEnt:
    """Weights of both softmaxes: each table has a row of 16 for each feature (and group, for classes in a group)."""

    SHAPES = {"bias1": 1, "last1": N_FEATURE, "skip1": N_FEATURE, "pair1": N_PAIR, "bias2": GROUP, "last2": N_FEATURE * GROUP, "skip2": N_FEATURE * GROUP}

    def __init__(self, tables: dict[str, np.ndarray] | None = None):
        self.w = tables or {k: np.zeros((n, GROUP), np.float32) for k, n in self.SHAPES.items()}

    @staticmethod
    def rows(cls: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
        group = cls // GROUP
        pair = (kn.mix(first.astype(np.uint64) << np.uint64(20) | second.astype(np.uint64), 31) % np.uint64(N_PAIR)).astype(np.int64)
        none = np.zeros(len(cls), np.int64)
        return {"bias1": none, "last1": first, "skip1": second, "pair1": pair, "bias2": group, "last2": first * GROUP + group, "skip2": second * GROUP + group}

    def softmax(self, rows: dict[str, np.ndarray], level: str) -> np.ndarray:
        x = np.zeros((len(rows["bias1"]), GROUP), np.float32)
        for k, at in rows.items():
            if k.endswith(level):
                x += self.w[k].take(at, 0)
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def log10(self, cls: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 of the class's probability for each token."""
        rows, i = self.rows(cls, first, second), np.arange(len(cls))
        p = self.softmax(rows, "1")[i, cls // GROUP].astype(np.float64) * self.softmax(rows, "2")[i, cls % GROUP]
        return np.log10(np.maximum(p, 1e-30))


class Trainer:
    """AdaGrad on minibatches, with how often each feature was seen."""

    def __init__(self, model: MaxEnt):
        self.model = MaxEnt({k: w.copy() for k, w in model.w.items()})
        self.square = {k: np.full_like(w, 1e-3) for k, w in self.model.w.items()}
        self.seen = {k: np.zeros(len(w), np.float32) for k, w in self.model.w.items()}

    def learn(self, cls: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        rows, i = MaxEnt.rows(cls, first, second), np.arange(len(cls))
        for level, target in (("1", cls // GROUP), ("2", cls % GROUP)):
            g = self.model.softmax(rows, level)
            g[i, target] -= 1
            columns = np.ascontiguousarray(g.T, np.float64)
            for k, at in rows.items():
                if not k.endswith(level):
                    continue
                n, at = len(self.model.w[k]), at.astype(np.intp)
                times = np.bincount(at, minlength=n)
                met = np.flatnonzero(times)
                d = np.stack([np.bincount(at, x, n)[met] for x in columns], 1).astype(np.float32)
                self.seen[k] += times
                self.square[k][met] += d * d
                self.model.w[k][met] -= RATE * d / np.sqrt(self.square[k][met])


def _minibatches(texts: pa.Array, head: Head) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for _, _, row, h, tail in sequences(texts):
        rank = head.words.find(h)
        cls, (first, second) = head.classes(rank, tail), history(row, head.features(rank, tail))
        for a in range(0, len(cls), MINIBATCH):
            s = slice(a, a + MINIBATCH)
            yield cls[s], first[s], second[s]


PIECE = 4096


def _train(head, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, any_ = Trainer(model.value), False
        for b in batches:
            for cls, first, second in _minibatches(b.column("text"), head.value):
                trainer.learn(cls, first, second)
                any_ = True
        if not any_:
            return
        for k, w in trainer.model.w.items():
            for a in range(0, len(w), PIECE):
                seen, part = trainer.seen[k][a : a + PIECE], w[a : a + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array([f"{k}:{a}"]), pa.array([(part * seen[:, None]).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["piece", "w", "seen"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[np.ndarray]] = {}
    for b in batches:
        for piece, w, seen in zip(b.column("piece").to_pylist(), b.column("w"), b.column("seen"), strict=True):
            x = [np.frombuffer(w.as_buffer(), np.float32), np.frombuffer(seen.as_buffer(), np.float32)]
            sums[piece] = [p + q for p, q in zip(sums[piece], x, strict=True)] if piece in sums else [x[0].astype(np.float64), x[1].astype(np.float64)]
    for piece, (w, seen) in sums.items():
        mean = w.reshape(-1, GROUP) / np.maximum(seen, 1)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["piece", "w"])


def train(texts: DataFrame, head: Head, rounds: int) -> MaxEnt:
    sc, model = texts.sparkSession.sparkContext, MaxEnt()
    shared = sc.broadcast(head)
    for _ in range(rounds):
        parts = texts.mapInArrow(_train(shared, sc.broadcast(model)), "piece string, w binary, seen binary")
        pieces = parts.repartition("piece").mapInArrow(_sum, "piece string, w binary").collect()  # as large as the weights
        tables = {k: np.zeros((n, GROUP), np.float32) for k, n in MaxEnt.SHAPES.items()}
        for r in pieces:
            k, a = r.piece.split(":")
            w = np.frombuffer(r.w, np.float32).reshape(-1, GROUP)
            tables[k][int(a) : int(a) + len(w)] = w
        model = MaxEnt(tables)
    return model


def kept_histories(row: np.ndarray, h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of known words whose ORDER - 1 words before are in the same text, and the hashes of these."""
    n = ORDER - 1
    if len(h) <= n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before = np.zeros(len(h) - n, np.uint64)
    for k in range(n):
        before = kn.mix(before ^ h[k : len(h) - n + k], 32)
    at = np.flatnonzero((row[n:] == row[:-n]) & known[n:])
    return at + n, before[at]


#: Codes of tokens that a task holds before it ships them, and positions of a bucket, about.
SHIPPED, BUCKET = 1 << 21, 1 << 20
_DOCUMENT = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"
_SHIPPED = f"{_DOCUMENT}, bucket int, size int, data binary"
_TOLD = f"{_DOCUMENT}, size int, found binary"


def _blank(n: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """n rows of a schema; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _schema(names: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in names.split(", "))])


def _thin(*arrays: np.ndarray) -> tuple[int, bytes]:
    """Arrays of whole numbers, byte by byte of significance, compressed: (size before, data). The high bytes are mostly zeros."""
    parts = []
    for x in arrays:
        parts += [np.array([len(x), x.itemsize, x.dtype.kind == "i"], "<i8").tobytes(), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return len(raw), pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _thick(size: int, data: bytes) -> list[np.ndarray]:
    raw, at, out = pa.Codec("zstd").decompress(data, size, asbytes=True), 0, []
    while at < size:
        n, width, signed = np.frombuffer(raw, "<i8", 3, at).tolist()
        x = np.frombuffer(raw, np.uint8, n * width, at + 24).reshape(width, n).T
        out.append(np.ascontiguousarray(x).view(f"<{'i' if signed else 'u'}{width}").ravel())
        at += 24 + n * width
    return out


class Runs:
    """Tokens on their way to where equal histories meet. A history goes by its rarest word, so neighbours mostly go the same way, and what
    goes are runs of tokens: ORDER - 1 words and those that follow while the rarest word is the same. A known word is its rank; others, by
    block, are numbers from head on (the caller's HEAD, as a worker may have another), with their hashes and endings."""

    def __init__(self, buckets: int, head: int = HEAD):
        self.buckets, self.head, self.held, self.size = buckets, head, [], 0

    def add(self, rid: np.ndarray, held_out: np.ndarray, row: np.ndarray, h: np.ndarray, rank: np.ndarray, tail: np.ndarray) -> None:
        n = ORDER - 1
        if len(h) <= n:
            return
        rare = np.where(rank < 0, self.head, rank).astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
        most = rare[: len(h) - n]
        for k in range(1, n):
            most = np.maximum(most, rare[k : len(h) - n + k])
        whole = np.flatnonzero(row[n:] == row[:-n])  # places of first words of histories
        if not len(whole):
            return
        most = most[whole]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(whole) != 1) | (most[1:] != most[:-1])]))
        length = np.diff(np.append(new, len(whole))) + n
        bucket = (kn.mix(most[new], 33) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin, length, bucket = whole[new][order], length[order], bucket[order]
        at = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
        doc = row[begin]
        cuts, ends = np.searchsorted(bucket, np.arange(self.buckets + 1)), np.concatenate([[0], np.cumsum(length)])
        self.held.append((cuts, ends, length, rid[doc], held_out[doc], rank[at], h[at], tail[at]))
        self.size += len(at)

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, size, data) of all that is held."""
        for k in range(self.buckets if self.held else 0):
            parts = []
            for cuts, ends, length, rid, held_out, rank, h, tail in self.held:
                r, t = slice(cuts[k], cuts[k + 1]), slice(ends[cuts[k]], ends[cuts[k + 1]])
                parts.append((length[r], rid[r], held_out[r], rank[t], h[t], tail[t]))
            length, rid, held_out, rank, h, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(length):
                continue
            new = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
            strange = np.flatnonzero(rank < 0)
            hashes, first, number = np.unique(h[strange], return_index=True, return_inverse=True)
            code = rank.astype("<u4")
            code[strange] = self.head + number
            times = np.diff(np.append(new, len(rid)))
            yield k, *_thin(code, length.astype("<u4"), times.astype("<u4"), np.diff(rid[new], prepend=0), held_out[new].astype(np.uint8), hashes, tail[strange][first].astype("<i2"))
        self.held, self.size = [], 0


def followers(history: np.ndarray, word: np.ndarray, own: np.ndarray, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hit, S) of the positions of some histories, all positions of each, for which one or the other isn't 0. q: from places, whose
    words and histories are distinct, to log10 of the probabilities so far. Own positions are of training, and leave themselves out."""
    order = np.argsort(history)
    new = np.concatenate([[True], history[order][1:] != history[order][:-1]]) if len(order) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    n = int(new.sum())
    # nothing to learn from, or nobody to tell
    kept = np.flatnonzero(((np.bincount(which, own, n) >= 1) & (np.bincount(which, minlength=n) >= 2))[which])
    _, which = np.unique(which[kept], return_inverse=True)
    words, number = np.unique(word[kept], return_inverse=True)
    pairs, first, pair = np.unique(which * max(1, len(words)) + number, return_index=True, return_inverse=True)
    p = 10.0 ** q(kept[first]).astype(np.float64)
    c = np.bincount(pair, own[kept], len(pairs))
    s = np.bincount(which[first], np.where(c > 0, p, 0.0))
    mine = own[kept]
    hit = c[pair] - mine > 0
    rest = np.maximum(0.0, s[which] - np.where(mine & (c[pair] == 1), p[pair], 0.0)) if len(kept) else np.zeros(0)
    some = hit | (rest > 0)
    return kept[some], hit[some], rest[some]


def _score(head, model, buckets: int):
    schema = _schema(_SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd, me, runs = head.value, model.value, Runs(buckets, HEAD)
        logs = np.log10(hd.counts + 1.0)

        def shipped() -> Iterator[pa.RecordBatch]:
            for k, size, data in runs.blocks():
                yield _blank(1, schema, bucket=pa.array([k]), size=pa.array([size]), data=pa.array([data], pa.binary()))

        for b in batches:
            rid, held_out = b.column("rid").to_numpy(), b.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, row, h, tail in sequences(b.column("text")):
                n, rank = hi - lo, hd.words.find(h)
                cls, (first, second) = hd.classes(rank, tail), history(row, hd.features(rank, tail))
                lp = np.concatenate([me.log10(cls[a : a + MINIBATCH], first[a : a + MINIBATCH], second[a : a + MINIBATCH]) for a in range(0, len(cls), MINIBATCH)])
                known = rank >= 0
                word = np.where(known, logs[np.maximum(rank, 0)] if len(logs) else 0.0, 0.0)
                base = np.bincount(row, word - hd.log_total, n)
                score = np.bincount(row, lp + word - hd.log_class[cls], n)
                rr, hh = row[~known], h[~known]
                order = np.argsort(hh)
                order = order[np.argsort(rr[order].astype(np.uint16), kind="stable")]
                rr, hh = rr[order], hh[order]
                new = np.flatnonzero(np.concatenate([[True], (rr[1:] != rr[:-1]) | (hh[1:] != hh[:-1])])) if len(rr) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rr))).astype(np.int32)
                ends = pa.array(np.searchsorted(rr[new], np.arange(n + 1)).astype(np.int32))
                yield _blank(
                    n,
                    schema,
                    rid=b.column("rid").slice(lo, n),
                    doc_id=b.column("doc_id").slice(lo, n),
                    held_out=b.column("held_out").slice(lo, n),
                    n_tokens=pa.array(np.bincount(row, minlength=n)),
                    known=pa.array(np.bincount(row, known, n).astype(np.int64)),
                    base=pa.array(base),
                    score=pa.array(score),
                    rare=pa.ListArray.from_arrays(ends, pa.array(hh[new].view(np.int64))),
                    times=pa.ListArray.from_arrays(ends, pa.array(times)),
                    bucket=pa.array(rid[lo:hi] % buckets),
                )
                runs.add(rid[lo:hi], held_out[lo:hi], row, h, rank, tail)
                if runs.size > SHIPPED:
                    yield from shipped()
        yield from shipped()

    return run


def _tell(head, model):
    """Documents as they are, and what the histories of each bucket tell of positions."""
    schema = _schema(_TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd, me = head.value, model.value
        logs = np.log10(hd.counts + 1.0)

        def told(blocks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            shift, codes, hashes, tails = 0, [], [], []
            for code, *_, h, tail in blocks:
                codes.append(np.where(code >= HEAD, code + np.uint32(shift), code))
                hashes.append(h)
                tails.append(tail)
                shift += len(h)
            code, strange = np.concatenate(codes), np.concatenate(hashes)
            length, times, held_out = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 4))
            rid = np.concatenate([np.cumsum(b[3]) for b in blocks])
            doc, run = np.repeat(np.arange(len(rid)), times), np.repeat(np.arange(len(length), dtype=np.int32), length)
            known = code < HEAD
            h = np.empty(len(code), np.uint64)
            h[known], h[~known] = hd.words.keys[code[known]], strange[code[~known] - HEAD]
            at, before = kept_histories(run, h, known)
            del h
            own = held_out[doc[run[at]]] == 0
            tails = np.concatenate(tails)

            def q(place: np.ndarray) -> np.ndarray:
                out = np.empty(len(place), np.float32)
                for a in range(0, len(place), MINIBATCH):
                    where = at[place[a : a + MINIBATCH]]
                    rank, tail = [], []
                    for back in (0, 1, 2):
                        c = code[where - back].astype(np.int64)
                        r = np.where(c < HEAD, c, -1)
                        rank.append(r)
                        tail.append(np.where(r >= 0, hd.endings[np.maximum(r, 0)], tails[np.maximum(c - HEAD, 0)] if len(tails) else 0))
                    cls = hd.classes(rank[0], tail[0])
                    out[a : a + MINIBATCH] = me.log10(cls, hd.features(rank[1], tail[1]), hd.features(rank[2], tail[2])) + logs[rank[0]] - hd.log_class[cls]
                return out

            place, hit, s = followers(before, code[at], own, q)
            of = doc[run[at[place]]]
            yield _blank(1, schema, **_found(rid[of], held_out[of] != 0, hit, s))

        held, now = [], None
        for b in batches:
            texts = b.filter(b.column("data").is_null())
            if texts.num_rows:
                yield _blank(texts.num_rows, schema, **{n: texts.column(n) for n in texts.schema.names if n in schema.names and n != "size"})
            for r in np.flatnonzero(b.column("data").is_valid().to_numpy(zero_copy_only=False)).tolist():
                bucket = b.column("bucket")[r].as_py()
                if held and bucket != now:
                    yield from told(held)
                    held = []
                now = bucket
                held.append(_thick(b.column("size")[r].as_py(), b.column("data")[r].as_py()))
        if held:
            yield from told(held)

    return run


def _found(rid: np.ndarray, held_out: np.ndarray, hit: np.ndarray, s: np.ndarray) -> dict[str, pa.Array]:
    """Positions as one row."""
    size, found = _thin(np.diff(rid, prepend=0), (held_out | hit << 1).astype(np.uint8), s.astype("<f4").view("<u4"))
    return {"size": pa.array([size]), "found": pa.array([found], pa.binary())}


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rid, held_out, hit, s of rows of `_found`."""
    for b in batches:
        for r in range(b.num_rows):
            steps, flags, s = _thick(b.column("size")[r].as_py(), b.column("found")[r].as_py())
            yield np.cumsum(steps), flags & 1 == 1, flags & 2 == 2, s.view("<f4").astype(np.float64)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not (batches := list(batches)):
        return
    t = pa.Table.from_batches(batches)
    rid, own, before, word, q = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("rid", "own", "before", "word", "q"))
    place, hit, s = followers(before, word, own, lambda at: q[at])
    yield _blank(1, _schema("size int, found binary"), **_found(rid[place], ~own[place], hit, s))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held_out, hit, s in _positions(batches):
        hit, s = hit[~held_out], s[~held_out]
        bands, at = np.unique(np.floor(np.log2(np.maximum(s, 1e-12)) * 4).astype(np.int64), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(bands), *(pa.array(np.bincount(at, w, len(bands)).astype(np.float64)) for w in (None, hit, s))], ["band", "n", "hit", "s"])


def _gained(weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, _, hit, s in _positions(batches):
            rids, at = np.unique(rid, return_inverse=True)
            gain = hit * (weight / np.log(10)) - np.log10(1 + np.expm1(weight) * np.minimum(s, 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.bincount(at, gain, len(rids)).astype(np.float64))], ["rid", "logs"])

    return run


def _weight(bins: list[tuple[float, float, float]]) -> float:
    """The weight at which (n positions, n whose word followed elsewhere, mean S) bins have no gradient: what is found equals what
    is expected. The expectation grows with the weight, so halving finds it."""
    lo, hi = 0.0, 30.0
    for _ in range(60):
        x = (lo + hi) / 2
        expected = sum(n * np.exp(x) * s / (1 + np.expm1(x) * s) for n, _, s in bins)
        lo, hi = (x, hi) if expected < sum(hit for _, hit, _ in bins) else (lo, x)
    return lo


def followed(scored: DataFrame) -> DataFrame:
    """(rid, n, base, logs): `gains` of positions as lists: rid, held_out, before (histories), word, q."""
    each = scored.select("rid", (~F.col("held_out")).alias("own"), F.explode(F.arrays_zip("before", "word", "q")).alias("x"))
    each = each.select("rid", "own", "x.before", "x.word", "x.q").repartition("before")
    return gains(written(each.mapInArrow(_follow, "size int, found binary"), "lm-followed"))


def gains(rows: DataFrame) -> DataFrame:
    """(rid, n, base, logs): what the feature of n-grams seen elsewhere adds to the log10 probability of each text (n and base are 0), of
    rows of `_found`; a text may have several rows."""
    bins = rows.mapInArrow(_bands, "band long, n double, hit double, s double").groupBy("band").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("s").alias("s")).collect()  # some hundred at most
    weight = _weight([(r.n, r.hit, r.s / r.n) for r in bins]) if bins else 0.0
    told = rows.mapInArrow(_gained(weight), "rid long, logs double")
    return told.select("rid", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("base"), "logs")


def counted(texts: DataFrame) -> tuple[DataFrame, Head, int]:
    """(counts of all words, what tasks need to know of them, tokens in all) of training texts."""
    counts = texts.mapInArrow(_count, "h long, ending int, c long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))
    counts = written(counts, "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = commonest(counts, "c", HEAD)[0].toArrow().sort_by([("c", "descending"), ("h", "ascending")])  # HEAD rows at most
    by = {r.ending: (r.t, r.v) for r in counts.groupBy("ending").agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect()}  # SURFACE + 1 rows
    hashes, count, tail = (top.column(c).to_numpy() for c in ("h", "c", "ending"))
    size = np.ones(OWN + SURFACE)
    for e, (t, v) in by.items():
        if e >= 0:
            own = tail[: OWN - 1] == e
            size[OWN + e] = t - count[: OWN - 1][own].sum() + v - own.sum() + 1
    size[: OWN - 1][: len(count[: OWN - 1])] = count[: OWN - 1] + 1
    ends = int(count[tail < 0].sum())
    size[OWN - 1] = ends + 1
    head = Head(kn.HashIndex(hashes.view(np.uint64)), count, tail, float(np.log10(total + distinct + 1)), np.log10(size))
    return counts, head, int(total)


def fit(texts: DataFrame, rounds: int = 2) -> tuple[Head, MaxEnt]:
    """The counts' head and the model of training texts (a column `text`)."""
    head = counted(texts)[1]
    return head, train(texts, head, rounds)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("text"))
    texts = rows.filter(~F.col("held_out")).select("text")
    counts, head, total = counted(texts)
    model = train(texts, head, rounds)
    sc = spark.sparkContext
    buckets = max(1, -(-total // BUCKET))
    shared, model = sc.broadcast(head), sc.broadcast(model)
    shipped = rows.mapInArrow(_score(shared, model, buckets), _SHIPPED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    told = written(shipped.mapInArrow(_tell(shared, model), _TOLD), "lm-scores")
    scored = told.filter("found IS NULL").drop("size", "found")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    logs = F.col("n") * F.log10(F.col("c") + 1.0)
    rare = rare.join(counts.select("h", "c").hint("merge"), "h").select("rid", F.col("n").cast("long").alias("n"), logs.alias("base"), logs.alias("logs"))
    more = rare.unionByName(gains(told.filter("found IS NOT NULL").select("size", "found"))).groupBy(F.col("rid").alias("r_")).agg(F.sum("n").alias("more"), F.sum("base").alias("to_base"), F.sum("logs").alias("logs"))
    found = scored.drop("rare", "times").join(more.hint("merge"), F.col("rid") == F.col("r_"), "left")
    zero = lambda c, none=0.0: F.coalesce(c, F.lit(none))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more", 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("to_base")).alias("base_score"), (F.col("score") + zero("logs")).alias("score"),
    )
