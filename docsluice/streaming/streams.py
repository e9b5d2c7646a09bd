"""Structured Streaming: ingest with dedup, ledger appends, event counts.

Dedup and ledgers keep their state in the stream: the hashes seen, the end of
each chain. So a batch costs what it holds, nothing of the target is read again,
and a restart goes on from the checkpoint. The file sink takes each batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as T
from ..operators import collection, ledger

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state of any size, on the executors' disks, for queries started inside."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _started(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    with _state_store(rows.sparkSession):
        return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


BUCKETS = 4096  # groups that hashes are dealt to; a checkpoint holds for the number that it began with


class _FirstSeen(StatefulProcessor):
    """Of each hash of a bucket that was never seen, the row with the smallest row_id of the batch; of others, nothing.

    A bucket is one call for all its rows, as a call costs far more than a row. Its state has an entry for each hash, so a batch reads those that it holds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "sha256 string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            part = part if best is None else pd.concat([best, part])
            best = part.sort_values("row_id", kind="stable").drop_duplicates("sha256")  # nulls come last
        if best is None:
            return
        new = [not self.seen.containsKey((sha,)) for sha in best["sha256"]]
        for sha in best["sha256"][new]:
            self.seen.updateValue((sha,), (True,))
        yield best[new].drop(columns="bucket")

    def close(self) -> None:
        pass


def ingest_stream(raw: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """raw: a stream of row_id, title, raw, category. Takes what is there, then ends; new documents by sha256 go to the table ``target``."""
    fine = collection.validated(raw).where("load_error is null").select("sha256", "row_id", "title", "category", "text")
    dealt = fine.withColumn("bucket", F.pmod(F.xxhash64("sha256"), F.lit(BUCKETS)).cast("int"))
    new = dealt.groupBy("bucket").transformWithStateInPandas(_FirstSeen(), fine.schema, "Append", "None")
    return _started(new.select(T.document_key(F.col("sha256")).alias("doc_key"), "row_id", "title", "category", "sha256", "text"), target, checkpoint)


class _Chain(StatefulProcessor):
    """Extends one ledger's chain; the state is its last index and hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "idx bigint, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        idx, last = self.end.get() if self.end.exists() else (-1, ledger.GENESIS)
        out = []
        for ts, kind, summary, data in zip(batch["ts"], batch["event_type"], batch["payload_summary"], batch["data_hash"], strict=True):
            idx += 1
            now = ledger.record_hash(idx, ts, kind, data, last)
            out.append((key[0], idx, ts, kind, summary, data, last, now))
            last = now
        self.end.update((idx, last))
        yield pd.DataFrame(out, columns=["ledger", "idx", "ts", "event_type", "payload_summary", "data_hash", "previous_hash", "current_hash"])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """events: a stream of ledger, ts (text), seq, event_type, payload_summary, data_hash. Each batch extends the chains in the order of (ts, seq); chained records go to the table ``target``."""
    schema = f"ledger {events.schema['ledger'].dataType.simpleString()}, {ledger.RECORD}"
    rows = events.select("ledger", "ts", "seq", "event_type", "payload_summary", "data_hash")
    return _started(rows.groupBy("ledger").transformWithStateInPandas(_Chain(), schema, "Append", "None"), target, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_batch(target: str, key: str = "ledger") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function, for tables that no stream keeps state of, that extends each ledger's chain by the batch's events (key, idx within the batch, ts, event_type, payload_summary, data_hash)."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ends = None
        if _exists(spark, target):
            kind = batch.schema[key].dataType.simpleString()
            old = spark.read.schema(f"{key} {kind}, {ledger.RECORD}, batch bigint").parquet(target).where(F.col("batch") != number)
            ends = old.groupBy(key).agg(F.max("idx").alias("n")).select(key, (F.col("n") + 1).alias("n"))
        rows = batch.select(key, "idx", "ts", "event_type", "payload_summary", "data_hash")
        if ends is None:
            rows = rows.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(ledger.GENESIS).alias("prev"))
        else:
            last = old.join(ends, key).where(F.col("idx") == F.col("n") - 1).select(key, "n", F.col("current_hash").alias("prev"))
            rows = rows.join(last, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("prev", F.coalesce("prev", F.lit(ledger.GENESIS)))
        ledger.fold(rows, key, ("n", "prev")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling windows; events later than ``late`` behind the watermark are out. Works on streams and on tables."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
