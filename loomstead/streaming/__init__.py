"""Time-driven behaviour as Structured Streaming: throttles, tumbling totals, bursts, alert state, ingestion, expiry.

Every function takes a streaming frame (or a batch one where it says so) and returns one; `drained` runs a stream over what
there is and gives the rows it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loomstead.operators.corpus import chunk_text, chunks
from loomstead.sources.keyed import KeyedTable
from loomstead.storage import shared_dir


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the parquet file or folder at a path, event times as timestamps. A trigger takes all files that are there:
    files may overlap in time, and taken one by one the watermark of one would drop rows of the next as late."""
    plain = spark.readStream.schema(schema).parquet(path)
    return plain.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def drained(stream: DataFrame, mode: str = "append", also: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; each batch is written once under its number, and then
    given to `also` as it was written. folder: where its state is, and is taken up again."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if also:
            also(spark.read.schema(batch.schema).parquet(f"{folder}/rows/batch={number}"), number)

    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def usage_totals(stream: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """Totals of closed windows by category; rows later than the watermark are left out."""
    w = stream.withWatermark("created_at", late).groupBy(F.window("created_at", f"{hours} hours").alias("w"), "category")
    sums = w.agg(F.sum("total_tokens").alias("total"), F.count("*").alias("calls"))
    return sums.select(F.col("w.start").cast("string").alias("bucket"), "category", "total", "calls")


def bursts(stream: DataFrame, key: str, quiet: str, late: str = "1 hour") -> DataFrame:
    """One row for each burst of a key that a quiet time has ended."""
    s = stream.withWatermark("created_at", late).groupBy(F.session_window("created_at", quiet).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").cast("string").alias("began"), "n")


def _throttle(key: str, limit: int, window_s: float):
    """Rows come sorted by key, at and id; from batch to batch only the last key's window and count are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, last, opened, used = False, None, None, 0
        for b in batches:
            allowed = []
            for k, at in zip(b.column(key).to_pylist(), b.column("at").to_pylist(), strict=True):
                if not started or k != last:
                    started, last, opened, used = True, k, at, 0
                elif at is not None and opened is not None and at >= opened + window_s:
                    opened, used = at, 0
                used += 1
                allowed.append(used <= limit)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column(key), pa.array(allowed, pa.bool_())], ["id", key, "allowed"])

    return run


def throttle(rows: DataFrame, key: str, limit: int, window_s: float) -> DataFrame:
    """id, key, allowed (batch form): a window opens with a key's first event and lasts window_s; events past the limit are
    denied until it ends. A key's events are a sequence, so one task runs through them in order, batch by batch, and holds
    two numbers of the key; events without a time come last, in the window that is open. See throttle_stream."""
    at = (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("at")
    events = rows.select(F.col("id").cast("long").alias("id"), F.col(key).cast("long").alias(key), at)
    events = events.repartition(key).sortWithinPartitions(key, F.asc_nulls_last("at"), "id")
    return events.mapInArrow(_throttle(key, limit, window_s), f"id long, {key} long, allowed boolean")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(stream: DataFrame, key: str, processor, out: str) -> DataFrame:
    """Rows of a watermarked stream through a processor with state and event-time timers of each key. Such state needs the
    RocksDB store, which also keeps it off the heap."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime")


class _Throttle(StatefulProcessor):
    """When the key's window opened, and how many events it took; a timer ends the window and takes both away."""

    def __init__(self, key: str, limit: int, window_us: int):
        self.key, self.limit, self.window_us = key, limit, window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, used long")

    def _ends(self, opened: int) -> int:
        return -(-(opened + self.window_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(b["at"].to_numpy(np.int64), b["id"].to_numpy(np.int64)) for b in rows]  # two numbers an event
        at, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, at))
        before = opened, used = self.window.get() if self.window.exists() else (None, 0)
        allowed = np.empty(len(at), bool)
        for n, i in enumerate(order):
            if opened is None or at[i] >= opened + self.window_us:
                opened, used = int(at[i]), 0
            used += 1
            allowed[n] = used <= self.limit
        if opened != before[0]:
            if before[0] is not None:
                self.handle.deleteTimer(self._ends(before[0]))
            self.handle.registerTimer(self._ends(opened))
        self.window.update((opened, used))
        yield pd.DataFrame({"id": ids[order], self.key: key[0], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle_stream(stream: DataFrame, key: str, limit: int, window_s: float, late: str = "1 hour") -> DataFrame:
    """As throttle, on a stream: a key's state is two numbers while its window is open, and nothing once the watermark has passed
    the end; the next event would open a new one anyway. Events of a batch are taken in order of time; those later
    than the watermark, or without a time, are left out."""
    timed = stream.filter("created_at IS NOT NULL").withWatermark("created_at", late)
    keyed = timed.select(F.col("id").cast("long").alias("id"), F.col(key).cast("long").alias(key), F.unix_micros("created_at").alias("at"), "created_at")
    return _stateful(keyed, key, _Throttle(key, limit, round(window_s * 1e6)), f"id long, {key} long, allowed boolean")


class _Expiry(StatefulProcessor):
    """A row's end. Its timer tells that the row is past and takes the state away; a later row of the key moves the end."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = max(((int(s), int(u)) for b in rows for s, u in zip(b["seen"], b["until_us"], strict=True)), default=None)
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0] // 1000 + 1)
        if last[1] // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            self.until.clear()
            yield pd.DataFrame({self.key: [key[0]], "until_us": [last[1]]})
        else:
            self.until.update((last[1],))
            self.handle.registerTimer(last[1] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0]
        self.until.clear()
        yield pd.DataFrame({self.key: [key[0]], "until_us": [until]})

    def close(self) -> None:
        pass


def expired_stream(stream: DataFrame, key: str, until: str, seen: str, late: str = "0 seconds") -> DataFrame:
    """(key, until) of rows whose time is past, each once, when the watermark of `seen` passes it; state is held for rows that are
    to expire yet, and for no others. The latest row of a key counts; rows without an end never enter the state."""
    rows = stream.filter(F.col(until).isNotNull() & F.col(key).isNotNull()).withWatermark(seen, late)
    kind = stream.schema[key].dataType.simpleString()
    rows = rows.select(key, F.unix_micros(F.col(until).cast("timestamp")).alias("until_us"), F.unix_micros(seen).alias("seen"), F.col(seen).alias("seen_at"))
    return _stateful(rows, key, _Expiry(key), f"{key} {kind}, until_us long").select(key, F.timestamp_micros("until_us").alias(until))


ALERTS = "asset_id string, title string, first_seen timestamp, last_seen timestamp, n long"


def alert_state(stream: DataFrame, table: KeyedTable) -> DataFrame:
    """Runs over what is there: first seen, last seen and count of each alert, kept in a table of ALERTS by asset and title. A batch
    is added up before it meets the table, and rewrites only the buckets of its own alerts; one that is run again counts once."""

    def sink(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("asset_id", "title").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("n"))
        add = lambda old: old.unionByName(new).groupBy("asset_id", "title").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))
        table.apply(number, new, add)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{table.path}/stream").trigger(availableNow=True).start().awaitTermination()
    return table.read()


def ingest(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Documents whose content was not seen before, within the watermark."""
    return stream.withColumn("h", F.sha2("text", 256)).withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["h"])


def ingested(stream: DataFrame, key: str, late: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Runs an ingestion over all that is there: (documents, chunks) as its sinks hold them. A batch writes its unseen
    documents and their chunks under its number, so one that is repeated writes the same again."""
    folder = f"{shared_dir(stream.sparkSession)}/chunks-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        chunks(batch, key, "text").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    documents = drained(ingest(stream, late), also=sink)
    return documents, stream.sparkSession.read.option("basePath", folder).parquet(folder)


def expire(rows: DataFrame, until: str, now) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows whose time is past): batch or stream. Rows without an end stay."""
    past = F.coalesce(F.col(until) < now, F.lit(False))
    return rows.filter(~past), rows.filter(past)


def register(spark: SparkSession) -> None:
    """fold(text) and chunks(text) for SQL users."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_no int, content string")
    class Chunks:
        def eval(self, text: str):
            yield from enumerate(chunk_text(text))

    spark.udtf.register("chunks", Chunks)
    spark.sql(_fold_function())


def _fold_function() -> str:
    """The SQL of functions.text.fold, for letters that fold to ASCII (others are left to the column function)."""
    from loomstead.functions.text import SEVERAL, SINGLE

    body = f"translate(regexp_replace(t, '[\\\\u0300-\\\\u036f]', ''), '{''.join(SINGLE)}', '{''.join(SINGLE.values())}')"
    for letter, plain in SEVERAL.items():
        if plain.isascii():
            body = f"replace({body}, '{letter}', '{plain}')"
    return f"CREATE OR REPLACE TEMPORARY FUNCTION fold(t STRING) RETURNS STRING RETURN CASE WHEN octet_length(t) = length(t) THEN t ELSE {body} END"
