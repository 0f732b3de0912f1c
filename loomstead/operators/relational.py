"""Joins, counts, ranks, pages and set operations that the queries share. Frames in, frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.storage import kept


def both_ways(edges: DataFrame, source: str, target: str, rel: str) -> DataFrame:
    """(node, other, rel, direction) of every edge from either end: what touches a node becomes an equi-join."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), rel, F.lit("out").alias("direction"))
    back = edges.filter(F.col(source) != F.col(target)).select(F.col(target).alias("node"), F.col(source).alias("other"), rel, F.lit("in").alias("direction"))
    return out.unionByName(back)


def inside(edges: DataFrame, members: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Edges with both ends among the members."""
    m = members.select(key).distinct()
    return edges.join(m.withColumnRenamed(key, source), source, "left_semi").join(m.withColumnRenamed(key, target), target, "left_semi")


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, degree), each edge counted at both ends; both ends are counted in one pass."""
    return edges.select(F.explode(F.array(source, target)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def counts_with_zero(keys: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    return keys.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_", rank).filter(F.col("rank_") <= n).drop("rank_")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page: sizes are held to 1..200 and numbers to 1 or more; total and n_pages (1 or more) stand on every row."""
    size, number = max(1, min(200, size)), max(1, number)
    total = rows.agg(F.count("*").alias("total")).withColumn("n_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total), how="cross")  # total is one row


def capped(rows: DataFrame, order: list[Column], most: int = 500) -> DataFrame:
    """The first rows, with the true total and whether some are missing."""
    total = rows.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > most)
    return rows.orderBy(*order).limit(most).join(F.broadcast(total), how="cross")  # total is one row


def by_list(column: Column, values: list[str]) -> list[Column]:
    """Order by a fixed list, unknown values after it by text, null last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), column)
    return [F.when(column.isNull(), len(values) + 2).when(at == 0, len(values) + 1).otherwise(at), column.asc_nulls_last()]


def best_of(lists: list[DataFrame], key: str, score: str) -> DataFrame:
    """All lists in one, each key with its best-scored whole row."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    best = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), F.struct(score, *[c for c in every.columns if c not in (key, score)])).alias("row"))
    return best.select("row.*")


def ordered_union(base: DataFrame, new: DataFrame, name: str, order: str) -> DataFrame:
    """Names of base in order, then those of new that base lacks."""
    both = base.select(name, F.struct(F.lit(0).alias("list"), F.col(order).alias("at")).alias("p")).unionByName(new.select(name, F.struct(F.lit(1).alias("list"), F.col(order).alias("at")).alias("p")))
    return both.groupBy(name).agg(F.min("p").alias("p"))


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with `out`: their numbers from 1 in an order, without a task that holds them all. Rows are dealt by ranges of the
    order and numbered within; each range begins where those before it end."""
    ranged = kept(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("part_").count().orderBy("part_").collect()  # a row a partition
    before = [(r["part_"], sum(x["count"] for x in counts[:i])) for i, r in enumerate(counts)]
    starts = rows.sparkSession.createDataFrame(before or [(-1, 0)], "p_ int, before_ long")
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    found = ranged.withColumn("place_", place).join(F.broadcast(starts), F.col("part_") == F.col("p_"))
    return found.withColumn(out, (F.col("before_") + F.col("place_")).cast("long")).drop("part_", "p_", "before_", "place_")


def levels(totals: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, k, above, run, all): how often each value occurs, and how many totals, with what sum, are larger. There
    are at most about sqrt(2 x sum) different values, so a window over them is small where one over all totals is not."""
    w = Window.partitionBy(*group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    each = totals.groupBy(*group, value).agg(F.count("*").alias("k"))
    zero = F.lit(0).cast("long")
    part = (F.col("k") * F.col(value)).cast("long")
    return each.withColumns({"above": F.coalesce(F.sum("k").over(w), zero), "run": F.coalesce(F.sum(part).over(w), zero), "all": F.sum(part).over(Window.partitionBy(*group))})


def half_at(value: str) -> Column:
    """Of levels(): the rank at which the sum of the largest reaches half, if that is inside the level; else null."""
    into = F.when(F.col(value) > 0, F.ceil(F.try_divide(F.col("all") - 2 * F.col("run"), 2 * F.col(value)))).otherwise(1)
    into = F.greatest(into, F.lit(1))
    return F.when(into <= F.col("k"), F.col("above") + into)


def running_half(totals: DataFrame, group: list[str], value: str) -> DataFrame:
    """How many of the largest values make half of the sum, per group (none: over all)."""
    return levels(totals, group, value).groupBy(*group).agg(F.min(half_at(value)).cast("long").alias("leaders"))


def keep_first_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The oldest row keeps its key, the others get null and are marked as collisions."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(by))
    return rows.withColumn("n_", n).withColumn("collides", F.col("n_") > 1).withColumn(key, F.when(F.col("n_") == 1, F.col(key))).drop("n_")
