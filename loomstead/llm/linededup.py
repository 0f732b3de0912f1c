"""Line dedup over levelled sorted runs.

A run is a bucketed, sorted table of line hashes (128 bits) and in how many documents each occurs. Each
batch of documents is merge-anti-joined with the sealed runs (keys that have reached the limit already),
and what is new in it becomes a run of the lowest level. Keys in open runs aren't taken out: their counts are
still needed. A level that is full is compacted: its runs are merged, keys that were sealed meanwhile go, keys
at the limit are sealed, the rest moves up a level; so each key is sealed once. Buckets and sort order are the
same in every run, so joins of runs are merge joins. The tables of the runs are dropped when the keys are known.

Defined results: null and empty text have one empty line; empty keys are never dropped; a repeated row is a
document of its own, and so is one with a null id; an empty table gives an empty result; columns of other
names stay as they are, helper columns take names that are free.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import fresh, sized_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column) -> Column:
    """Two 64-bit hashes of a line's key; null for an empty key."""
    key = F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


class LineRuns:
    """Levelled runs of (h1, h2, n). add() takes one row for each key of each document of a batch."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or min(512, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.levels: list[list[str]] = []
        self.sealed: list[str] = []

    def _save(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged two by two: full outer merge joins, which bucketed and sorted runs need no shuffle for."""
        runs = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m").hint("merge")
            runs = runs.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return runs

    def _unsealed(self, keys: DataFrame) -> DataFrame:
        """keys without those that are sealed: merge-anti-joins, for which runs of the same buckets need no shuffle."""
        for name in self.sealed:
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        merged = self._save(self._unsealed(self._merged(old)))  # a key may have been sealed after one of the runs was made
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")
        rest, full = self.spark.table(merged).filter(F.col("n") < self.min_docs), self.spark.table(merged).filter(F.col("n") >= self.min_docs)
        self.sealed.append(self._save(full))
        self._push(level + 1, self._save(rest))
        self.spark.sql(f"DROP TABLE {merged}")

    def add(self, keys: DataFrame) -> None:
        self._push(0, self._save(self._unsealed(keys.groupBy("h1", "h2").agg(F.count("*").alias("n")))))

    def frequent(self) -> DataFrame:
        """(h1, h2) of every key in at least min_docs documents, each once."""
        found = [self.spark.table(name).select("h1", "h2") for name in self.sealed]
        if open_ := [name for level in self.levels for name in level]:
            found.append(self._unsealed(self._merged(open_).filter(F.col("n") >= self.min_docs).select("h1", "h2")))
        every = found[0]
        for d in found[1:]:
            every = every.unionByName(d)
        return every

    def drop(self) -> None:
        """Drops the tables of all runs."""
        for name in [*self.sealed, *(name for level in self.levels for name in level)]:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels, self.sealed = [], []


def drop_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, text: str = "text", out: str = "lines_") -> DataFrame:
    """docs with `out`: a struct of n_lines, n_dropped and kept (the text without lines that min_docs documents have).

    The lines to drop depend on a text alone, so they are found once for each distinct text, by a 128-bit hash of it."""
    spark = docs.sparkSession
    t1, t2, f = fresh(docs, "t1_", "t2_", "flags_")
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"), F.transform(lines(F.col(text)), line_hash).alias("hs"))
    hashed = written(hashed, "line-hashes")
    runs = LineRuns(spark, min_docs)
    for k in range(batches):  # the result is the same for any number of batches
        batch = hashed.filter(F.pmod("t1", F.lit(batches)) == k)
        runs.add(batch.select(F.explode(F.array_distinct(F.filter("hs", lambda h: h.isNotNull()))).alias("h")).select("h.h1", "h.h2"))
    frequent = written(runs.frequent(), "line-frequent").withColumn("hit", F.lit(True))
    runs.drop()
    each = hashed.groupBy("t1", "t2").agg(F.first("hs").alias("hs")).select("t1", "t2", F.posexplode("hs").alias("pos", "h"))
    each = sized_join(each.select("t1", "t2", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")), frequent, ["h1", "h2"], "left")
    flags = each.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("s"), F.max("hit").alias("any"))
    flags = written(flags.filter("any").select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("s.hit").alias(f)), "line-flags")
    k1, k2 = F.xxhash64(body), F.xxhash64(F.lit(1), body)
    rows = docs.drop(out).join(flags.hint("merge"), (k1 == F.col(t1)) & (k2 == F.col(t2)), "left")
    dropped = F.coalesce(F.size(F.filter(f, lambda x: x)), F.lit(0))
    dropped = F.when(F.col(f).isNull(), 0).otherwise(dropped)
    kept = F.when(F.col(f).isNull(), body).otherwise(F.array_join(F.filter(lines(F.col(text)), lambda line, i: ~F.get(F.col(f), i)), "\n"))
    every = F.size(lines(F.col(text))).cast("long")
    return rows.withColumn(out, F.struct(every.alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept"))).drop(t1, t2, f)


SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT k) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS hit FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY k, doc_id
"""
