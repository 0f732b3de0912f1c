"""Hard negatives by Four-Russians scoring.

Vectors are integers. A candidate is kept as packed bit planes: of each plane (two's complement, the sign plane last) one byte holds
the bits of eight dimensions. For a block of anchors the sums of all 256 subsets of each group of eight dimensions are laid out once;
a candidate's byte is the place of its sum. Per plane the looked-up sums of all groups are added, and the planes are shifted and
added to the full exact score: no score is estimated, none is left out. A row has only as many planes as its largest component needs.

Anchors meet candidates in a grid of cells: candidates are dealt to `across` parts and anchors to `down` parts, by row number, and a
cell scores one part against the other. Parts have a bounded number of rows at every size of the table, and both grow in number
with it. Each cell passes on only the first few of each anchor, so what is shuffled grows with anchors and parts and not with pairs.
Two rounds: the first scores rows of one label and finds the positives; the second knows their scores, and so the window of
scores that each anchor still wants, before it keeps anything.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a vector shorter than
the longest has zeros after its end, an empty one is all zeros; components whose scores could exceed a long are refused with an
error that names the bound. Repeated rows are rows each: a copy of an anchor is another row of its label, and an anchor held
twice is asked twice. Ties go by smaller vec_id. An anchor without positives, or a positive without negatives in its window,
gives no rows. An empty table gives an empty result. Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import written

GROUP = 8
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's lies, both included.
LEAST, MOST = 30, 90
#: Rows of a part at most, on average.
CANDIDATES, ANCHORS = 100_000, 8_192
#: Rows that are scored at once: sums of a block of anchors (256 x 8 x 8 x 2 bytes) and scores stay in a core's cache.
_ROWS, _ASKED = 512, 256

_CODES = "row long, vec_id long, label int, n_planes int, planes binary"
_HITS = "anchor long, slot int, score long, vec_id long"


def packed(q: np.ndarray, n_planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of integer vectors: bit k of a group's byte belongs to its dimension k."""
    bits = (q[:, None, :] >> np.arange(n_planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The integer vectors of packed planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weight = 1 << np.arange(planes.shape[1], dtype=np.int64)
    weight[-1] *= -1  # two's complement
    return np.einsum("rpd,p->rd", bits, weight)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for each byte, the sum of each anchor's components where the byte has bits."""
    groups = anchors.shape[1] // GROUP
    out = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    parts = anchors.T.reshape(groups, GROUP, len(anchors)).astype(kind)
    for k in range(GROUP):  # subsets with dimension k are those without it, and k added
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + parts[:, k, None]
    return out


def scores(sums: np.ndarray, planes: np.ndarray, kind: type) -> np.ndarray:
    """(candidates, anchors) exact inner products: looked-up sums, added over groups, shifted and added over planes."""
    out = None
    for p in reversed(range(planes.shape[1])):
        plane = sums[0].take(planes[:, p, 0], axis=0)
        for g in range(1, planes.shape[2]):
            plane += sums[g].take(planes[:, p, g], axis=0)
        if out is None:
            out = -plane.astype(kind)
        else:
            out <<= 1
            out += plane
    return out


class _First:
    """The first `keep` hits of each anchor and slot, by score and then id, and what a further hit must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low, high, keep  # (anchors, slots): scores that count; low rises as slots fill
        self.last = np.full(low.shape, np.iinfo(np.int64).max)  # of a full slot, the largest id that an equal score may have
        self.held = np.empty((0, 4), np.int64)  # anchor, slot, -score, id
        self.new: list[np.ndarray] = []
        self.n_new = 0

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        return self.low.min(axis=1), self.high.max(axis=1)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for s in range(self.low.shape[1]):
            low = self.low[anchor, s]
            fits = (score >= low) & (score <= self.high[anchor, s]) & ((score > low) | (ids <= self.last[anchor, s]))
            if fits.any():
                a = anchor[fits]
                self.new.append(np.stack([a, np.full(len(a), s), -score[fits], ids[fits]], axis=1))
                self.n_new += len(a)
        if self.n_new > 4 * len(self.held) + 50_000:
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.held, *self.new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        key = rows[:, 0] * self.low.shape[1] + rows[:, 1]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(rows) else np.empty(0, int)
        size = np.diff(np.r_[first, len(rows)])
        place = np.arange(len(rows)) - np.repeat(first, size)
        self.held, self.new, self.n_new = rows[place < self.keep], [], 0
        full = rows[place == self.keep - 1]
        self.low[full[:, 0], full[:, 1]], self.last[full[:, 0], full[:, 1]] = -full[:, 2], full[:, 3]
        return self.held


def _search(candidates: pd.DataFrame, anchors: pd.DataFrame, groups: int, low: np.ndarray, high: np.ndarray, keep: int, same: bool) -> pd.DataFrame:
    """The first `keep` candidates of each anchor and slot whose score lies in the slot's window. same: of the anchor's label, others
    than itself; else of other labels."""
    found = []
    candidates = candidates.sort_values("vec_id", kind="stable")
    blocks = []
    for n_planes, rows in candidates.groupby("n_planes"):
        planes = np.frombuffer(b"".join(rows["planes"]), np.uint8).reshape(len(rows), n_planes, groups)
        blocks += [(planes[i : i + _ROWS], *(rows[c].to_numpy()[i : i + _ROWS] for c in ("row", "vec_id", "label"))) for i in range(0, len(rows), _ROWS)]
    each = [unpacked(np.frombuffer(p, np.uint8).reshape(1, n, groups))[0] for p, n in zip(anchors["planes"], anchors["n_planes"])]
    q = np.stack(each)
    most_planes = int(candidates["n_planes"].max())
    for i in range(0, len(q), _ASKED):
        asked, row, label, at = q[i : i + _ASKED], anchors["row"].to_numpy()[i : i + _ASKED], anchors["label"].to_numpy()[i : i + _ASKED], np.arange(len(q))[i : i + _ASKED]
        reach = int(np.abs(asked).sum(axis=1).max())  # no sum of a plane is larger
        narrow = next(k for k in (np.int16, np.int32, np.int64) if reach <= np.iinfo(k).max)
        wide = np.int32 if reach << most_planes <= np.iinfo(np.int32).max else np.int64
        first = _First(low[at].copy(), high[at], keep)
        of_label = {x: np.flatnonzero(label == x) for x in np.unique(label)} if same else {None: np.arange(len(asked))}
        for x, mine in of_label.items():
            sums = subset_sums(asked[mine], narrow)
            for planes, rows, ids, labels in blocks:
                if same:
                    of = np.flatnonzero(labels == x)
                    if not len(of):
                        continue
                    planes, rows, ids, labels = planes[of], rows[of], ids[of], labels[of]
                s = scores(sums, planes, wide)
                least, most = (b[mine].astype(np.int64) for b in first.window())
                hit = np.flatnonzero((s >= least) & (s <= most))
                c, a = hit // len(mine), hit % len(mine)
                score = s.ravel()[hit].astype(np.int64)
                a = mine[a]
                fits = rows[c] != row[a] if same else labels[c] != label[a]
                first.add(a[fits], score[fits], ids[c[fits]])
        held = first.settle()
        found.append(pd.DataFrame({"anchor": row[held[:, 0]], "slot": held[:, 1].astype(np.int32), "score": -held[:, 2], "vec_id": held[:, 3]}))
    return pd.concat(found)


def coded(rows: DataFrame, quantise: Column, vec_id: str = "vec_id", label: Column | None = None, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows as codes, written once, and how many groups of eight dimensions they have. quantise: array of whole numbers."""
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("int").alias("label"), quantise.alias("q"), F.col(vector).alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    plain = plain.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(sound).drop("v")
    size, low, high = plain.agg(F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    groups, largest = max(1, -(-(size or 0) // GROUP)), max(high or 0, -(low or 0))
    if groups * GROUP * largest * (largest + 1) >= 1 << 62:
        raise ValueError(f"scores of components up to {largest} do not fit a long")

    def pack(frames):
        for f in frames:
            q = np.zeros((len(f), groups * GROUP), np.int64)
            for i, x in enumerate(f["q"]):
                q[i, : len(x)] = x
            n_planes = np.searchsorted(np.left_shift(1, np.arange(62)), np.abs(q).max(axis=1) + 1) + 1  # magnitude and sign
            planes = np.empty(len(f), object)
            for n in np.unique(n_planes):
                of = np.flatnonzero(n_planes == n)
                for i, p in zip(of, packed(q[of], n)):
                    planes[i] = p.tobytes()
            yield pd.DataFrame({"row": f["row"], "vec_id": f["vec_id"], "label": f["label"], "n_planes": n_planes.astype(np.int32), "planes": planes})

    plain = plain.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q")
    return written(plain.mapInPandas(pack, _CODES), "negatives-codes"), groups


def _first(hits: DataFrame, keep: int) -> DataFrame:
    """Of all cells' hits, the first of each anchor and slot as an array in order; each task passes on `keep` of them at most."""
    best = hits.select("anchor", "slot", (-F.col("score")).alias("below"), "vec_id")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy("below", "vec_id"))
    best = best.withColumn("place", place).filter(F.col("place") <= keep)
    return best.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(F.struct("below", "vec_id"))).alias("first"))


def _grid(codes: DataFrame, anchors: DataFrame, across: int, down: int, search) -> DataFrame:
    """search(candidates, anchors) in each cell."""

    def cells(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = cells(codes, "across", across, "down", down).groupBy("across", "down")
    right = cells(anchors, "down", down, "across", across)
    right = right.select(*[F.col(c).alias(f"a_{c}") for c in right.columns]).groupBy("a_across", "a_down")  # both sides come from one table

    def cell(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return search(c, a.rename(columns=lambda x: x[2:])) if len(c) and len(a) else pd.DataFrame({"anchor": [], "slot": [], "score": [], "vec_id": []}).astype({"slot": np.int32, "anchor": np.int64, "score": np.int64, "vec_id": np.int64})

    return left.cogroup(right).applyInPandas(cell, _HITS)


def mine(codes: DataFrame, groups: int, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where is_anchor holds, its first rows
    of the same label, and for each of these the first rows of other labels with least % to most % of its score."""
    spark = codes.sparkSession
    asked = codes.filter(is_anchor)
    n, k = codes.count(), asked.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-k // ANCHORS))
    across = max(-(-n // CANDIDATES), -(-min(tasks, 1 + n // 1000) // down), 1)
    top = np.iinfo(np.int64).max // 2

    def same_label(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return _search(c, a, groups, np.full((len(a), 1), -top), np.full((len(a), 1), top), positives, True)

    def other_labels(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        wanted = np.zeros((len(a), positives), np.int64)
        given = np.zeros((len(a), positives), bool)
        for i, x in enumerate(a["positive_scores"]):
            wanted[i, : len(x)], given[i, : len(x)] = x, True
        low, high = -((-least * wanted) // 100), (most * wanted) // 100
        return _search(c, a, groups, np.where(given, low, top), np.where(given, high, -top), negatives, False)

    near = written(_first(_grid(codes, asked, across, down, same_label), positives), "negatives-positives")
    near = near.select(F.col("anchor").alias("row"), "first").withColumn("positive_scores", F.transform("first", lambda x: -x["below"]))
    asked = written(asked.join(near.hint("merge"), "row"), "negatives-anchors")
    far = _first(_grid(codes, asked.drop("first"), across, down, other_labels), negatives)
    found = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("first").alias("slot", "positive"))
    found = found.join(far.withColumnRenamed("first", "far").hint("merge"), ["anchor", "slot"])
    found = found.select("anchor_id", "positive", F.posexplode("far").alias("at", "negative"))
    return found.select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        (-F.col("positive.below")).alias("positive_score"), (-F.col("negative.below")).alias("negative_score"),
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's form: components to floor(256 * x), the label of every seventh id moved on by one, every hundredth id an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    codes, groups = coded(embeddings.select("vec_id", "label", "embedding"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)), label=label)
    return mine(codes, groups, F.col("vec_id") % 100 == 0)


#: The same by sums over all pairs of an anchor and a row.
SQL = """WITH v AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score
    FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
    s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
