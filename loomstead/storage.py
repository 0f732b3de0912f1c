"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; on a cluster
    that would be a folder of one machine, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: short lineage, sizes that Spark knows, no work done twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None, limit: int = 500_000) -> DataFrame:
    """left join right, with right broadcast only if it was counted to have at most limit rows; else both are shuffled."""
    rows = right.count() if rows is None else rows
    return left.join(right.hint("broadcast" if rows <= limit else "merge"), on, how)


#: Rows of a task after `dealt`, about.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, dealt by keys into so many tasks that each gets some hundred thousand of its rows, of which there are about `rows`. What
    a grouping or join by these keys holds in a task then doesn't grow with the input."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *keys)


def bucketed(df: DataFrame, rows: int, key: str, name: str) -> DataFrame:
    """df, written as a table of the warehouse in buckets of some hundred thousand rows: joins and groupings by the key don't shuffle it."""
    spark, buckets, table = df.sparkSession, max(1, -(-rows // ROWS_A_TASK)), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def settled(column: Column) -> Column:
    """The column, tied to a row number, which is never negative. Spark doesn't move filters below a column that counts rows,
    nor does it put this column's expression into others, where a lambda would compute it anew for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def sized_cross(left: DataFrame, right: DataFrame, limit: int = 10_000) -> DataFrame:
    """Every pair of rows; right is broadcast only if it was counted to have at most limit rows."""
    return left.join(right.hint("broadcast" if right.count() <= limit else "shuffle_replicate_nl"), how="cross")
