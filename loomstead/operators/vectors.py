"""Exact and quantised nearest neighbours, and inverted lists.

Rows and queries are packed into blocks of some megabytes, and blocks of queries meet blocks of rows as rows of a join, in numpy. No vector
goes through the driver; what does is of a fixed size (the centroids of the lists)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.storage import kept, sized_join

#: Floats of a block: 4 MB. Queries are broadcast to all rows' tasks while they have at most so many bytes; above, every part of the
#: rows meets every part of the queries.
BLOCK_FLOATS = 1 << 20
BROADCAST_BYTES = 64 << 20
_PACKED = "ids binary, data binary, width int"
_FOUND = "qid long, id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norm > 0, m / np.where(norm > 0, norm, 1), 0).astype(np.float32)


#: Scores are rounded to five digits before ties go by id, so whatever may tie after rounding comes along.
TIE = 1.1e-5


#: Scores that a task computes at once: 16 MB, beside which a few matrices of the same size stand while they are compared.
TILE_SCORES = 1 << 22
#: Candidates (20 bytes each) that a task holds before it hands them on.
HELD = 1 << 23


def _scored(q: bytes, n_queries: int, data: bytes, ids: np.ndarray, width: int, scores: Callable) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first query, number of queries, ids, their scores) of a block of queries and one of rows, in tiles of at most TILE_SCORES."""
    q, data, step = memoryview(q), memoryview(data), max(1, min(n_queries, 1024))
    q_bytes, bytes_, rows = len(q) // max(1, n_queries), len(data) // max(1, len(ids)), max(1, TILE_SCORES // step)
    for i in range(0, n_queries, step):
        n = min(step, n_queries - i)
        for j in range(0, len(ids), rows):
            m = min(rows, len(ids) - j)
            yield i, n, ids[j : j + m], scores(q[i * q_bytes : (i + n) * q_bytes], data[j * bytes_ : (j + m) * bytes_], width)


class _Best:
    """The k best scores of each query among the rows that a task has seen, with what may tie at the edge."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.edge = np.full(n, -np.inf, np.float32)

    def see(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row a query, a column an id."""
        if scores.shape[1] > self.k:
            self.edge = np.maximum(self.edge, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        q, i = np.nonzero(scores >= self.edge[:, None] - TIE)
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids[i]]), np.concatenate([self.score, scores[q, i]])
        order = np.lexsort((-score, q))
        q, ids, score = q[order], ids[order], score[order]
        begin = np.searchsorted(q, np.arange(self.n))
        last = begin + self.k - 1
        full = np.flatnonzero(np.bincount(q, minlength=self.n) >= self.k)
        self.edge[full] = np.maximum(self.edge[full], score[last[full]])
        keep = score >= self.edge[q] - TIE
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def _pack(encode: Callable[[np.ndarray], np.ndarray], kind: str):
    """Blocks (ids, data, width) of the rows (id, v) of a task; encode: unit vectors to rows of `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, ids = _matrix(b.column("v")), b.column("id").to_numpy().astype(np.int64)
            data = encode(_unit(m))
            step = max(1, BLOCK_FLOATS // max(1, m.shape[1]))
            for i in range(0, len(ids), step):
                part = np.ascontiguousarray(data[i : i + step], kind)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + step].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], ["ids", "data", "width"])

    return run


def packed(rows: DataFrame, key: str, vector: str, encode: Callable[[np.ndarray], np.ndarray] = lambda m: m, kind: str = "<f4") -> DataFrame:
    """Rows as blocks, without a shuffle. Rows without a vector are left out; vectors are of one length."""
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    return plain.mapInArrow(_pack(encode, kind), _PACKED)


def _meet(blocks: DataFrame, queries: DataFrame, k: int, scores: Callable, held: int = HELD) -> DataFrame:
    """(qid, id, score) of what may be among the k best of each query, once a task and block of queries, or each time a task holds `held`. scores: (query data, row data,
    width) to a matrix."""
    n_bytes = queries.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    asked = queries.select(F.col("ids").alias("qids"), F.col("data").alias("q"))
    pairs = blocks.join(asked.hint("broadcast" if n_bytes <= BROADCAST_BYTES else "shuffle_replicate_nl"), how="cross")

    def told(best: dict) -> Iterator[pa.RecordBatch]:
        for (qids, i), x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(qids, np.int64)[i:][x.q]), pa.array(x.id), pa.array(x.score.astype(np.float64))], ["qid", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[bytes, int], _Best] = {}
        now = 0
        for b in batches:
            for r in range(b.num_rows):
                ids, data, width, qids, q = (b.column(c)[r].as_py() for c in ("ids", "data", "width", "qids", "q"))
                for i, n, some, found in _scored(q, len(qids) // 8, data, np.frombuffer(ids, np.int64), width, scores):
                    x = best.setdefault((qids, i), _Best(n, k))
                    now -= len(x.q)
                    x.see(some, found)
                    now += len(x.q)
                if now > held:  # what goes on now is ranked with the rest later
                    yield from told(best)
                    best, now = {}, 0
        yield from told(best)

    return pairs.mapInArrow(run, _FOUND)


def _products(q: bytes, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(q, "<f4").reshape(-1, width) @ np.frombuffer(data, "<f4").reshape(-1, width).T


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 5) -> DataFrame:
    """(qid, id, score, rank): the k rows of largest cosine for each query, ties by id; a zero vector scores 0."""
    asked = kept(packed(queries, key, vector), "vector-queries")
    return _ranked(_meet(packed(rows, key, vector), asked, k, _products).withColumn("score", F.round("score", digits)), k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dimensions(rows: DataFrame, vector: str) -> DataFrame:
    """(dimension, n): more than one row means that the table is mixed; 0 stands for empty or missing vectors."""
    return rows.groupBy(F.coalesce(F.when(F.size(vector) > 0, F.size(vector)), F.lit(0)).cast("long").alias("dimension")).agg(F.count("*").alias("n"))


def _mutual(hits: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, weight), a < b: the k nearest of enough similarity, weights to one decimal, the larger of both ways."""
    hits = _ranked(hits.filter("qid <> id").filter(F.col("score") >= least).select("qid", "id", "score"), k)
    return hits.select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), F.round("score", 1).alias("weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))


def neighbour_graph(rows: DataFrame, key: str, vector: str, k: int, least: float, lists: Lists | None = None, probes: int | None = None) -> DataFrame:
    """(a, b, weight), a < b: each row's k nearest of enough similarity, weights to one decimal, the larger of both ways. With lists,
    each row is held only against the `probes` lists nearest to it (none given: all of them, which is exact)."""
    hits = top_k(rows, rows, key, vector, k + 1) if lists is None else lists.top_k(rows, key, vector, k + 1, probes)
    return _mutual(hits, k, least)


class Lists:
    """Inverted lists: rows by their nearest centroid, in blocks of some thousand rows.

    Centroids are fitted by Lloyd's rounds on at most `sample` rows, chosen by hash; every row is indexed. Each round's sums are formed in
    tasks and added by a grouping, so the driver sees n_lists vectors and no rows. A large list is many blocks, which are dealt
    to tasks by list and salt, so that a list with a third of all rows is no task of its own."""

    BLOCKS_A_SALT = 8
    MOST_LISTS = 4096

    def __init__(self, rows: DataFrame, key: str, vector: str, n_lists: int, rounds: int = 5, sample: int = 1 << 18, seed: int = 1):
        if not 0 < n_lists <= self.MOST_LISTS:
            raise ValueError(f"1 to {self.MOST_LISTS} lists")
        plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
        self.centroids = self._fit(plain, n_lists, rounds, sample, seed)
        nearest = plain.mapInArrow(self._assign(1), "list int, id long, v binary, width int")
        block_rows = max(64, BLOCK_FLOATS // max(1, self.centroids.shape[1]) // 4)
        sizes = kept(nearest.groupBy("list").agg(F.count("*").alias("n")), "lists-sizes")
        self.sizes = sizes.select("list", F.ceil(F.col("n") / (block_rows * self.BLOCKS_A_SALT)).cast("int").alias("salts"))  # n_lists rows at most
        salted = nearest.join(F.broadcast(self.sizes), "list").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        salted = salted.repartition("list", "salt").sortWithinPartitions("list", "salt")
        self.blocks = kept(salted.select("list", "salt", "id", "v").mapInArrow(_bundle(block_rows), f"list int, salt int, {_PACKED}"), "lists")

    def _fit(self, plain: DataFrame, n_lists: int, rounds: int, sample: int, seed: int) -> np.ndarray:
        n = plain.count()
        at = F.xxhash64(F.lit(seed), "id")
        some = plain.filter(F.pmod(at, F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n, 1)))
        some = kept(some, "lists-sample")
        first = some.orderBy(at, "id").limit(n_lists).collect()
        c = _unit(np.array([r.v for r in first], np.float32)) if first else np.zeros((0, 1), np.float32)
        for _ in range(rounds if len(c) else 0):
            sums = some.mapInArrow(_sums(c), "list int, sum array<double>, n long")
            each = sums.select("list", "n", F.posexplode("sum").alias("d", "x")).groupBy("list", "d").agg(F.sum("x").alias("x"))
            for r in each.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("s")).collect():  # n_lists rows at most
                c[r.list] = [x.x for x in r.s]
            c = _unit(c)
        return c

    def _assign(self, probes: int):
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = _unit(_matrix(b.column("v")))
                    n = min(probes, len(c))
                    near = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :n]
                    ids = np.repeat(b.column("id").to_numpy(), n)
                    each = [m[i].tobytes() for i in range(len(m)) for _ in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(ids), pa.array(each, pa.binary()), pa.array(np.full(len(ids), m.shape[1], np.int32))], ["list", "id", "v", "width"])

        return run

    def top_k(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, digits: int = 5) -> DataFrame:
        """(qid, id, score, rank) among the rows of the `probes` lists nearest to each query (none given: all lists)."""
        if not len(self.centroids):
            return queries.sparkSession.createDataFrame([], f"{_FOUND}, rank long")
        plain = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
        asked = plain.mapInArrow(self._assign(probes or len(self.centroids)), "list int, id long, v binary, width int")
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")).repartition("list", "salt").sortWithinPartitions("list", "salt")
        width = self.centroids.shape[1]
        asked = asked.select("list", "salt", "id", "v").mapInArrow(_bundle(max(64, BLOCK_FLOATS // width // 4)), f"list int, salt int, {_PACKED}")
        asked = kept(asked, "lists-asked").select("list", F.col("ids").alias("qids"), F.col("data").alias("q"))
        asked = asked.join(F.broadcast(self.sizes), "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        pairs = self.blocks.join(asked.hint("merge"), ["list", "salt"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    ids, data, qids, q = (b.column(c)[r].as_py() for c in ("ids", "data", "qids", "q"))
                    best: dict[int, _Best] = {}
                    for i, n, some, found in _scored(q, len(qids) // 8, data, np.frombuffer(ids, np.int64), width, _products):
                        best.setdefault(i, _Best(n, k)).see(some, found)
                    for i, x in best.items():
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(qids, np.int64)[i:][x.q]), pa.array(x.id), pa.array(x.score.astype(np.float64))], ["qid", "id", "score"])

        return _ranked(pairs.mapInArrow(run, _FOUND).withColumn("score", F.round("score", digits)), k)


def _sums(c: np.ndarray):
    """The sum and number of a task's rows for each centroid that is nearest to some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                m = _unit(_matrix(b.column("v")))
                near = np.argmax(m @ c.T, axis=1)
                np.add.at(total, near, m)
                n += np.bincount(near, minlength=len(c))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64())), pa.array(n[at])], ["list", "sum", "n"])

    return run


def _bundle(rows: int):
    """Blocks of at most so many rows (list, salt, id, v) that follow one another and share list and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts = None, [], []

        def block() -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([len(data) // len(ids) // 4], pa.int32())], ["list", "salt", "ids", "data", "width"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("list", "salt", "id", "v")), strict=True):
                if ids and (x[:2] != key or len(ids) == rows):
                    yield block()
                    ids, parts = [], []
                key = x[:2]
                ids.append(x[2])
                parts.append(x[3])
        if ids:
            yield block()

    return run


def quantise(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, codes, scale): 4 bits a dimension, two in a byte, by the largest component of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"))
            scale = np.abs(m).max(1, initial=0) if m.size else np.zeros(len(m))
            level = np.clip(np.rint(m / np.where(scale > 0, scale, 1)[:, None] * 7), -7, 7).astype(np.int8) + 8
            level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
            packed = (level[:, ::2].astype(np.uint8) << 4) | level[:, 1::2].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(scale.astype(np.float64))], [key, "codes", "scale"])

    return rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL").mapInArrow(run, f"{key} long, codes binary, scale double")


def rotated(m: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows with random signs through a Walsh-Hadamard transform: products and lengths stay, and no dimension stands out, so that
    few levels serve all of them. The width grows to a power of two."""
    width = 1 << max(1, (m.shape[1] - 1).bit_length())
    x = np.zeros((len(m), width), np.float32)
    x[:, : m.shape[1]] = m * np.where(np.random.default_rng(seed).random(m.shape[1]) < 0.5, -1, 1).astype(np.float32)
    step = 1
    while step < width:
        y = x.reshape(len(m), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(m), width)
        step *= 2
    return x / np.sqrt(np.float32(width))


def _levels(m: np.ndarray, most: int) -> np.ndarray:
    top = np.abs(m).max(1, initial=0)[:, None]
    return np.rint(m / np.where(top > 0, top, 1) * most)


def _coded(m: np.ndarray) -> np.ndarray:
    """Unit vectors to bytes: the inverse length of the levels (a float), then two levels of -7 to 7 a byte."""
    level = _levels(rotated(m), 7).astype(np.int8)
    length = np.sqrt((level.astype(np.float32) ** 2).sum(1))
    inverse = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0).astype("<f4")
    nibbles = (level + 8).astype(np.uint8)
    return np.concatenate([inverse[:, None].view(np.uint8), (nibbles[:, ::2] << 4) | nibbles[:, 1::2]], axis=1)


#: Both levels of each byte.
_PAIR = np.stack([np.arange(256) >> 4, np.arange(256) & 15], 1).astype(np.float32) - 8


def _code_products(q: bytes, data: bytes, width: int) -> np.ndarray:
    """Products of the levels of rows with queries of whole numbers up to 127: whole numbers that a float holds exactly."""
    wide = 1 << max(1, (width - 1).bit_length())
    rows = np.frombuffer(data, np.uint8).reshape(-1, 4 + wide // 2)
    asked = np.frombuffer(q, np.int8).reshape(-1, wide).astype(np.float32)
    inverse = np.ascontiguousarray(rows[:, :4]).view("<f4").ravel()
    length = np.sqrt((asked**2).sum(1))
    levels = _PAIR[rows[:, 4:]].reshape(len(rows), wide)
    return (asked @ levels.T) * inverse / np.where(length > 0, length, 1)[:, None]


def code_blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The code table of a scan: rotated, 4 bits a dimension, in blocks; written once, and read instead of the vectors."""
    return kept(packed(rows, key, vector, _coded, "u1"), "vector-codes")


def _asked_codes(queries: DataFrame, key: str, vector: str) -> DataFrame:
    return kept(packed(queries, key, vector, lambda m: _levels(rotated(m), 127), "i1"), "vector-asked")


def top_k_codes(codes: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(qid, id, score, rank) by codes alone."""
    return _ranked(_meet(codes, _asked_codes(queries, key, vector), k, _code_products), k)


def top_k_quantised(codes: DataFrame, rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, over: int = 3) -> DataFrame:
    """As top_k, by codes (code_blocks of the same rows): over x k candidates for each query, scored again on their vectors."""
    near = top_k_codes(codes, queries, key, vector, k * over).select("qid", "id")
    a = rows.select(F.col(key).alias("id"), F.col(vector).alias("a_"))
    q = queries.select(F.col(key).alias("qid"), F.col(vector).alias("q_"))
    exact = near.join(a.hint("merge"), "id").join(q.hint("merge"), "qid").select("qid", "id", F.round(cosine(F.col("a_"), F.col("q_")), 5).alias("score"))
    return _ranked(exact, k)


def rank_by_codes(codes: DataFrame, queries: DataFrame, wanted: DataFrame, key: str, vector: str) -> DataFrame:
    """(qid, place): where a scan by codes puts the wanted row (qid, id) of each query: one more than the rows that score above it,
    counted in a second pass over the codes. Nothing is sorted, and a pass sends a number for each query and task."""
    asked = _asked_codes(queries, key, vector)
    of = wanted.select(F.col("qid").alias("w_"), F.col("id").alias("wanted"))

    def scan(aux: DataFrame, name: str, see: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """see(ids, scores, aux) to a number a query, those that keep() holds; aux (qid, name) goes beside each block as (qids, values)."""
        each = asked.select(F.col("ids").alias("qids"), F.col("data").alias("q"))
        beside = kept(aux.select(F.col("qid").cast("long"), F.col(name).cast("double")).mapInArrow(_columns, "k binary, x binary"), "rank-aux")
        pairs = codes.join(each.hint("shuffle_replicate_nl"), how="cross").join(beside.hint("shuffle_replicate_nl"), how="cross")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, data, width, qids, q, k, x in zip(*(b.column(c).to_pylist() for c in ("ids", "data", "width", "qids", "q", "k", "x")), strict=True):
                    qid, known, value = np.frombuffer(qids, np.int64), np.frombuffer(k, np.int64), np.frombuffer(x, np.float64)
                    at = np.clip(np.searchsorted(known, qid), 0, max(0, len(known) - 1))
                    there = known[at] == qid if len(known) else np.zeros(len(qid), bool)
                    if not there.any():
                        continue
                    out = see(np.frombuffer(ids, np.int64), _code_products(q, data, width)[there], value[at[there]])
                    good = keep(out)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[there][good]), pa.array(out[good].astype(np.float64))], ["qid", "x"])

        return pairs.mapInArrow(run, "qid long, x double")

    def own(ids: np.ndarray, scores: np.ndarray, want: np.ndarray) -> np.ndarray:
        hit = ids[None, :] == want.astype(np.int64)[:, None]
        return np.where(hit.any(1), scores[np.arange(len(want)), hit.argmax(1)], np.nan)

    score = kept(scan(of.select(F.col("w_").alias("qid"), "wanted"), "wanted", own, lambda x: ~np.isnan(x)), "rank-scores")
    above = scan(score.select("qid", "x"), "x", lambda ids, scores, x: (scores > x[:, None]).sum(1), lambda n: n > 0)
    more = above.groupBy(F.col("qid").alias("a_")).agg(F.sum("x").alias("n_"))
    return score.select("qid").join(more.hint("merge"), F.col("qid") == F.col("a_"), "left").select("qid", (F.coalesce("n_", F.lit(0.0)) + 1).cast("long").alias("place"))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number for each query, as two sorted columns in blocks of some hundred thousand."""
    for b in batches:
        k, x = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.argsort(k)
        yield pa.RecordBatch.from_arrays([pa.array([k[order].astype(np.int64).tobytes()], pa.binary()), pa.array([x[order].astype(np.float64).tobytes()], pa.binary())], ["k", "x"])


def mark(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: count and an order-free mark of a table, to tell whether codes were made from these very rows."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(key, vector)), F.lit(0)).alias("mark"))


def use_codes(made_of: DataFrame, now: DataFrame, least: int = 512) -> DataFrame:
    """One row: whether a scan may use the codes: made of these very rows, and enough of them."""
    both = made_of.withColumnsRenamed({"n": "n_", "mark": "mark_"}).join(F.broadcast(now), how="cross")  # a row each
    return both.select(((F.col("n") == F.col("n_")) & (F.col("mark") == F.col("mark_")) & (F.col("n") >= least)).alias("use_codes"))
