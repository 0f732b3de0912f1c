"""Mixing sources to target weights by the cube method.

Each source has a target of words and so a number of copies that each of its documents gets on average. Equal rows (of one
id, source and size) are a class: of m rows whose mean number of copies is c, floor(m x c) copies are given for certain, and
the fraction that is left is one unit with that probability; a row alone is a class of one. Units are drawn balanced on the
number of documents and of words: in blocks of some thousand units the vector of probabilities moves through the null-space
of the two constraints until all but two are 0 or 1. What is left of all blocks is dealt to blocks anew, until one block a
source is left. The units that stay open in a flight are the largest and the smallest of it, so the last block flies in strata
of like size, largest first: the one or two units that a stratum leaves land on the nearest outcome, and the next stratum's
probabilities take up the words that this one missed. After the last landing units are exchanged while that brings the words
nearer to the target. Random numbers depend on seed, level, source and block alone. A class's copies are dealt evenly to its rows.

Nothing is held for all sources or documents at once: targets come from a few sums over the table of sources.

Defined results: null text has no words; null source is a source of its own, last in order; which of some equal rows gets
one copy more is open, the rows of the result are not; a source without words has target 0 and gives nothing; an empty table
gives an empty result; columns of other names stay as they are, helper columns take names that are free.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import SPACE_CLASS, fresh, sized_join, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Units in a block of the flight.
BLOCK = 4096
_EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, size), a row a source, to source, source_no, source_size and target. Sources by code point, null last,
    take the weights in turn; what a source can't give is shared out anew.

    A source is full if its share is above `most` times its size. With the full ones out, the others' shares only grow, so
    each round's full sources contain the last round's, and rounds end when none comes to them."""
    spark = sizes.sparkSession
    null_last = [F.col("source").isNull(), F.col("source")]
    ranged = written(sizes.repartitionByRange(*null_last).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").count().orderBy("part").collect()  # a row a partition
    before, at = [], 0
    for r in counts:
        before.append((r["part"], at))
        at += r["count"]
    starts = spark.createDataFrame(before or [(-1, 0)], "p_ int, before long")
    w = Window.partitionBy("part").orderBy(*null_last)
    rank = F.col("before") + F.row_number().over(w) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = ranged.join(F.broadcast(starts), F.col("part") == F.col("p_")).withColumn("source_no", rank).withColumn("weight", weight)
    rows = written(rows.select("source", "source_no", F.col("size").alias("source_size"), "weight"), "mix-ranked")
    total, every = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, open_ = float(total), float(every)
    is_full = lambda: F.lit(left) * F.col("weight") > F.lit(float(most)) * F.col("source_size") * F.lit(open_)
    while True:
        full = is_full()
        taken, n = rows.filter(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (float(total - most * taken), float(every - n)) == (left, open_):
            break
        left, open_ = float(total - most * taken), float(every - n)
    share = F.lit(left) * F.col("weight") / F.lit(max(open_, 1.0))
    return written(rows.select("source", "source_no", "source_size", F.when(full, most * F.col("source_size").cast("double")).otherwise(share).alias("target")), "mix-targets")


def _step(p: list[float], at: list[int], u: list[float], rng: random.Random) -> None:
    """Moves p[at] along u or against it to the border of the unit cube; the mean stays."""
    up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(at, u, strict=True) if x)
    down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(at, u, strict=True) if x)
    by = up if rng.random() * (up + down) < down else -down
    for i, x in zip(at, u, strict=True):
        v = p[i] + by * x
        p[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v


def _null(rows: list[list[float]], n: int) -> list[float]:
    """A vector of n entries, at most one more than there are rows, that is orthogonal to the rows."""
    if n == 3:
        a, b = rows
        u = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        if max(map(abs, u)) > 1e-9 * max(1.0, max(map(abs, b))):
            return u
        return _null(rows[:1], 2) + [0.0]  # b is a multiple of a
    if n == 2:
        a = rows[0]
        return [a[1], -a[0]] if a[0] or a[1] else [1.0, 0.0]
    return [1.0]


def flight(p: list[float], at: list[int], words: list[float], rng: random.Random) -> list[int]:
    """Moves p[at] until all but two are 0 or 1, number and words kept; gives those that are open."""
    window, todo = [], iter([i for i in at if 0 < p[i] < 1])
    while True:
        window = [i for i in window if 0 < p[i] < 1]
        while len(window) <= 2 and (i := next(todo, None)) is not None:
            window.append(i)
        if len(window) <= 2:
            return window
        _step(p, window, _null([[1.0] * len(window), [words[i] for i in window]], len(window)), rng)


def _take_up(p: list[float], at: list[int], words: list[float], miss: float) -> float:
    """Adds one number to all p[at], within 0 and 1, such that their words change by miss; gives what does not fit in."""
    free = [i for i in at if words[i] > 0]
    while free and abs(miss) > _EPS:
        by = miss / sum(words[i] for i in free)
        for i in free:
            v = min(1.0, max(0.0, p[i] + by))
            miss -= (v - p[i]) * words[i]
            p[i] = v
        free = [i for i in free if (p[i] < 1 if miss > 0 else p[i] > 0)]
    return miss


def _exchange(p: list[float], at: list[int], words: list[float], gap: float, low: list[float], high: list[float]) -> float:
    """Takes a copy more or less of one unit, or of two, while that brings the words nearer; of three if units are few. gap: words that
    are wanted yet; gives what is left of it."""
    few = len(at) <= 40
    while abs(gap) > 0.5:
        moves = sorted([(words[i], i) for i in at if p[i] < high[i] and words[i] > 0] + [(-words[i], i) for i in at if p[i] > low[i] and words[i] > 0])

        def nearest(rest: float, taken: tuple[int, ...]) -> list[tuple[float, tuple]]:
            """The moves of other units next to `rest` on both sides."""
            k, found = bisect_left(moves, (rest,)), []
            for side in (range(k, len(moves)), range(k - 1, -1, -1)):
                m = next((moves[n] for n in side if moves[n][1] not in taken), None)
                found += [(abs(rest - m[0]), (m,))] if m else []
            return found

        options = nearest(gap, ())
        for a in moves:
            options += [(x, (a, *m)) for x, m in nearest(gap - a[0], (a[1],))]
        if few:
            for n, a in enumerate(moves):
                for b in moves[:n]:
                    if a[1] != b[1]:
                        options += [(x, (a, b, *m)) for x, m in nearest(gap - a[0] - b[0], (a[1], b[1]))]
        left, chosen = min(options, key=lambda o: (o[0], len(o[1])), default=(abs(gap), ()))
        if left >= abs(gap) - 1e-6:
            break
        for w, i in chosen:
            gap -= w
            p[i] += 1.0 if w > 0 else -1.0
    return gap


def landed(p: list[float], words: list[float], rng: random.Random, low: list[float] | None = None, high: list[float] | None = None) -> None:
    """All of p becomes whole, with the words as near to the expected as units allow: 0 or 1, and only where that stays more than 1 % off,
    as beside a document that is most of its source, other numbers between low and high. Units are in order of size, largest first."""
    units = [i for i, x in enumerate(p) if 0 < x < 1]
    wanted, miss, first = sum(p[i] * words[i] for i in units), 0.0, 0
    while first < len(units):
        last = first
        while last < len(units) and 2 * words[units[last]] >= words[units[first]]:
            last += 1
        stratum, first = units[first:last], last
        miss = _take_up(p, stratum, words, miss)
        hoped = sum(p[i] * words[i] for i in stratum)
        window = flight(p, stratum, words, rng)
        fixed = sum(p[i] * words[i] for i in stratum if i not in window)
        gap = lambda out: abs(hoped + miss - fixed - sum(words[i] * x for i, x in zip(window, out, strict=True)))
        number = lambda out: abs(sum(out) - sum(p[i] for i in window))
        outcomes = [(round(gap(out), 6), round(number(out), 6), rng.random(), out) for out in product((0.0, 1.0), repeat=len(window))]
        for i, x in zip(window, min(outcomes)[3], strict=True):
            p[i] = x
        miss += hoped - sum(p[i] * words[i] for i in stratum)
    n = len(p)
    gap = _exchange(p, units, words, wanted - sum(p[i] * words[i] for i in units), [0.0] * n, [1.0] * n)
    if abs(gap) > 0.01 * wanted and low and high:
        found = []
        for i in (None, *units[:3]):  # as it is, and with one of the largest the other way
            q = list(p)
            by = 0.0 if i is None else -1.0 if q[i] > low[i] else 1.0
            if i is not None:
                q[i] += by
            left = _exchange(q, [u for u in units if u != i], words, gap - (by * words[i] if i is not None else 0.0), low, high)
            found.append((round(abs(left), 6), len(found), q))
        p[:] = min(found)[2]


def _fly(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        rng = random.Random(f"{seed} {pdf.level.iloc[0]} {pdf.source_no.iloc[0]} {pdf.block.iloc[0]}")
        p, words = pdf.p.tolist(), pdf["size"].astype(float).tolist()
        if pdf.blocks.iloc[0] > 1:
            flight(p, list(range(len(p))), words, rng)
        else:
            landed(p, words, rng, (-pdf.whole.astype(float)).tolist(), (MOST_COPIES * pdf.rows.astype(float) - pdf.whole).tolist())
        return pdf.assign(p=p)

    return run


def copies(units: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """units: doc_id, source, size, a row a document. Gives (doc_id, source, size, rows, copies), one row for each distinct
    triple with its number of rows and the copies that all of them together get, and (source, source_size, target)."""
    classes = units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    classes = written(classes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-classes")
    table = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size")))
    n_sources = table.count()
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("rows")
    given = sized_join(classes, table.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")), "inner", rows=n_sources)
    given = given.withColumn("whole", F.floor(mean + 1e-9).cast("long")).withColumn("p", F.greatest(F.lit(0.0), mean - F.col("whole")))
    p = F.when(F.col("p") < 1e-9, 0.0).when(F.col("p") > 1 - 1e-9, 1.0).otherwise(F.col("p"))
    names = ["doc_id", "source", "size", "rows", "h", "source_no", "whole", "p"]
    left = given.withColumn("p", p).select(*names)
    schema = "doc_id long, source string, size long, rows long, h long, source_no long, whole long, p double, level int, blocks int, block int"
    done, level, is_open = [], 0, (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        left = written(left, f"mix-left-{level}")
        done.append(left.filter(~is_open))
        left = left.filter(is_open)
        number = written(left.groupBy(F.col("source_no").alias("b_")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "mix-blocks")
        if not (n := number.count()):
            break
        flown = sized_join(left, number, F.col("source_no") == F.col("b_"), "inner", rows=n).drop("b_")
        flown = flown.withColumns({"level": F.lit(level), "block": F.pmod(F.xxhash64(F.lit(level), "h"), F.col("blocks")).cast("int")})
        left = flown.groupBy("source_no", "block").applyInPandas(_fly(seed), schema).select(*names)
        level += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("doc_id", "source", "size", "rows", (F.col("whole") + F.round("p").cast("long")).alias("copies")), table.drop("source_no")


def dealt(rows: DataFrame, classes: DataFrame, doc_id: str, source: str, size: str, out: str) -> DataFrame:
    """rows with `out`, the copies of each: its class's, dealt evenly. Rows of a class are numbered for that only if they share
    its copies unevenly, and by partition, so that a class of very many rows is no task of its own."""
    d, s, n, m, c, part, no, before, again = fresh(rows, "d_", "s_", "n_", "m_", "c_", "part_", "no_", "before_", "again_")
    known = classes.toDF(d, s, n, m, c)
    on = F.col(doc_id).eqNullSafe(F.col(d)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(size) == F.col(n))
    even = rows.join(known.filter(F.col(c) % F.col(m) == 0).hint("merge"), on).withColumn(out, (F.col(c) / F.col(m)).cast("int"))
    odd = known.filter(F.col(c) % F.col(m) != 0)
    if (n_odd := odd.count()) == 0:
        return even.drop(d, s, n, m, c)
    some = sized_join(rows, odd, on, "inner", rows=n_odd)
    some = written(some.withColumn(part, F.spark_partition_id()), "mix-uneven")
    key = [d, s, n]
    counts = some.groupBy(*key, part).agg(F.count("*").alias("k"))
    first = F.sum("k").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(x).alias(f"{x}{again}") for x in (*key, part)], F.coalesce(first, F.lit(0)).alias(before))
    some = some.withColumn(no, F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))))
    same = [F.col(x).eqNullSafe(F.col(f"{x}{again}")) for x in (*key, part)]
    some = some.join(counts.hint("merge"), same[0] & same[1] & same[2] & same[3])
    share = F.floor(F.col(c) / F.col(m)) + F.when(F.col(before) + F.col(no) <= F.col(c) % F.col(m), 1).otherwise(0)
    some = some.withColumn(out, share.cast("int"))
    return even.select(*rows.columns, out).unionByName(some.select(*rows.columns, out))


def mix(docs: DataFrame, seed: int = 0, text: str = "text", out: str = "copies", source_out: str | None = None) -> DataFrame:
    """docs with `out`: how many times the mix takes the row, 0 to 3; with source_out also a struct of its source's size and target."""
    size, q = fresh(docs, "size_", "q_")
    sized = docs.drop(out).withColumn(size, n_words(F.col(text)))
    classes, table = copies(sized.select("doc_id", "source", F.col(size).alias("size")), seed)
    rows = dealt(sized, classes, "doc_id", "source", size, out)
    if source_out:
        table = table.select(F.col("source").alias(q), F.struct("source_size", "target").alias(source_out))
        rows = sized_join(rows, table, F.col("source").eqNullSafe(F.col(q)), "inner").drop(q)
    return rows.drop(size)


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row."""
    rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "mix-sizes")
    classes, table = copies(rows, seed)
    rows = dealt(rows, classes, "doc_id", "source", "size", "copies")
    rows = sized_join(rows, table.withColumnRenamed("source", "q_"), F.col("source").eqNullSafe(F.col("q_")), "inner")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
