"""A table that lives between runs: rows by key, in buckets, of which a batch rewrites only those that its keys fall in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SNAPSHOT = "n long, last long, bucket int, folder string"


class KeyedTable:
    """Parquet folders of buckets (by hash of the key columns), and a snapshot that says which folder holds each bucket now.

    A batch has a number. `apply` reads the buckets that the batch touches, lets `merge` make their new rows, writes these to a new folder,
    and writes the next snapshot last, as one file: readers see the table before the batch or after it, and a batch that is lost
    half-way leaves no trace but an unread folder. A batch whose number is not above the last one applied changes nothing, so that one
    that is run again after a failure counts once. One batch is applied at a time.

    Rows of a key are in one bucket; a key may have many rows. The driver sees the numbers of buckets, no rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> KeyedTable:
        table = cls(spark, path, schema, keys, buckets)
        table._publish(0, -1, {})
        return table

    def _publish(self, n: int, last: int, folders: dict[int, str]) -> None:
        rows = [(n, last, b, f) for b, f in sorted(folders.items())] or [(n, last, None, None)]
        self.spark.createDataFrame(rows, _SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{self.path}/snapshots")

    def _now(self) -> tuple[int, int, dict[int, str]]:
        every = self.spark.read.schema(_SNAPSHOT).parquet(f"{self.path}/snapshots")
        newest = every.agg(F.max("n")).first()[0]
        rows = every.filter(F.col("n") == newest).collect()  # a row a bucket
        return newest, rows[0]["last"], {r.bucket: r.folder for r in rows if r.bucket is not None}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{f}/bucket_={b}" for b, f in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._now()[2])

    def apply(self, number: int, batch: DataFrame, merge: Callable[[DataFrame], DataFrame], touched: DataFrame | None = None) -> bool:
        """merge: the stored rows of the touched buckets to their new rows, those of the batch among them. touched: the keys that the
        batch may change, where they are more than its own. Tells whether the batch was applied."""
        n, last, folders = self._now()
        if number <= last:
            return False
        hit = [r[0] for r in (batch if touched is None else touched).select(self._bucket()).distinct().collect()]
        rows = merge(self._rows({b: folders[b] for b in hit if b in folders})).withColumn("bucket_", self._bucket())
        folder = f"{self.path}/data/{n + 1}-{uuid.uuid4().hex}"
        rows.repartition("bucket_").write.partitionBy("bucket_").parquet(folder)
        full = [r[0] for r in self.spark.read.schema(f"{self.schema}, bucket_ int").parquet(folder).select("bucket_").distinct().collect()]
        self._publish(n + 1, number, {b: f for b, f in folders.items() if b not in hit} | dict.fromkeys(full, folder))
        return True
