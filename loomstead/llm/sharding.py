"""Sharding by longest processing time: groups that must stay together, by size, to the least-loaded shard.

The heap works on a bounded number of items, whatever the input: groups larger than 1/(shards x per_shard)
of all bytes (there are fewer than shards x per_shard of them) and as many bundles of smaller groups, dealt
by hash of the group. Items go largest first. The rows only meet broadcast tables of that bounded size.

Defined results: null text has no bytes and is grouped with the empty text; rows with equal
texts share a shard, repeated rows and null ids included; ties of size go by item key; an empty table gives
an empty result; columns of other names stay as they are, helper columns take names that are free.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import crc32_text, fresh, sized_join, utf8_bytes, written

#: Bytes that each row counts besides its text.
ROW_BYTES = 16


def longest_first(items: list[tuple[int, str]], n_shards: int) -> dict[str, int]:
    """(bytes, key) items to shards: sorted by size, each to the shard with the least load (ties: lowest shard)."""
    heap = [(0, k) for k in range(n_shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def group_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def assign(docs: DataFrame, n_shards: int = 40, text: str = "text", per_shard: int = 256, out: str = "shard") -> DataFrame:
    """docs with the column `out` (it replaces one of that name): the shard of each row."""
    spark, n_items = docs.sparkSession, n_shards * per_shard
    size = utf8_bytes(F.col(text)) + ROW_BYTES
    groups = written(docs.select(group_key(F.col(text)).alias("g"), size.alias("size")).groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bundle = lambda g: F.concat(F.lit("b"), F.pmod(F.xxhash64(g), F.lit(n_items)))
    large = F.col("bytes") * n_items > total
    items = groups.groupBy(F.when(large, F.col("g")).otherwise(bundle(F.col("g"))).alias("item")).agg(F.sum("bytes").alias("bytes"))
    placed = longest_first([(r.bytes, r.item) for r in items.toLocalIterator()], n_shards)  # under 2 x n_items items
    table = spark.createDataFrame(list(placed.items()) or [("", 0)], "item string, shard int")
    g, b, s1, s2, k1, k2 = fresh(docs, "g_", "bundle_", "s1_", "s2_", "k1_", "k2_")
    rows = docs.drop(out).withColumns({g: group_key(F.col(text))}).withColumn(b, bundle(F.col(g)))
    rows = rows.join(F.broadcast(table.select(F.col("item").alias(k1), F.col("shard").alias(s1))), F.col(g) == F.col(k1), "left")
    rows = rows.join(F.broadcast(table.select(F.col("item").alias(k2), F.col("shard").alias(s2))), F.col(b) == F.col(k2), "left")
    return rows.withColumn(out, F.coalesce(s1, s2)).drop(g, b, s1, s2, k1, k2)


def number(rows: DataFrame, n_shards: int, shard: str, order: list[str], out: str = "slot", per_cell: int = 50_000) -> DataFrame:
    """rows with `out`: gapless numbers from 0 in each shard. Rows are numbered within cells of a shard (dealt by hash
    of the order columns, about per_cell rows each), and each cell starts where the cells before it end."""
    cell, first, count, s_, c_ = fresh(rows, "cell_", "first_", "count_", "shard_", "cell__")
    cells = max(1, -(-rows.count() // (n_shards * per_cell)))
    rows = rows.drop(out).withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = rows.groupBy(F.col(shard).alias(s_), F.col(cell).alias(c_)).agg(F.count("*").alias(count))
    before = Window.partitionBy(s_).orderBy(c_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(s_, c_, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(first))
    rows = rows.withColumn(out, F.row_number().over(Window.partitionBy(shard, cell).orderBy(*order)) - 1)
    rows = sized_join(rows, starts, (F.col(shard) == F.col(s_)) & (F.col(cell) == F.col(c_)), "left", rows=n_shards * cells)
    return rows.withColumn(out, (F.col(out) + F.col(first)).cast("long")).drop(cell, first, s_, c_)


def shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    d = docs.select("doc_id", "text")
    rows = assign(d, n_shards).select(
        "doc_id", (utf8_bytes(F.col("text")) + ROW_BYTES).alias("size"), crc32_text(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard"
    )
    rows = written(rows, "shard-rows")
    return number(rows, n_shards, "shard", ["doc_id", "text_crc32", "size"]).withColumn("grown_shard", F.lit(None).cast("int"))
