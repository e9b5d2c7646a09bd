"""State kept across batches and restarts: dedup of documents and chains of ledgers."""

import pandas as pd
from pyspark.sql import functions as F

from docsluice.operators import ledger
from docsluice.streaming import streams


def test_dedup_over_batches_and_restarts(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "row_id bigint, title string, raw string, category string"
    batches = [[(3, "c", "same", "LEGAL"), (1, "a", "same", "LEGAL"), (2, "b", "other", "GENERAL"), (9, "x", " ", "LEGAL"), (8, "y", None, "LEGAL")], [(0, "z", "same", "LEGAL"), (4, "d", "new", "LEGAL")], []]
    for i, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{landing}/{i}")
        raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landing)
        streams.ingest_stream(raw, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target)
    assert sorted((r["row_id"], r["text"]) for r in got.collect()) == [(1, "same"), (2, "other"), (4, "new")]
    assert got.columns == ["doc_key", "row_id", "title", "category", "sha256", "text"]


def test_chains_over_batches_and_restarts(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = spark.range(60).select((F.col("id") % 3).alias("ledger"), F.floor(F.col("id") / 3).alias("idx"), F.format_string("t%03d", "id").alias("ts"), F.col("id").alias("seq"), F.lit("ERROR").alias("event_type"), F.lit("s").alias("payload_summary"), F.sha2(F.col("id").cast("string"), 256).alias("data_hash"))
    for i, which in enumerate(("seq < 10", "seq >= 10 and seq < 45", None, "seq >= 45")):
        if which:
            events.where(which).repartition(3).write.parquet(f"{landing}/{i}")
        rows = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(landing)
        streams.ledger_stream(rows, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target)
    want = ledger.chained(events)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert all(r["valid"] and r["n"] == 20 for r in ledger.verified(got).collect())


class _Seen:
    """A map state in memory."""

    def __init__(self):
        self.held = {}

    def getMapState(self, *_):  # noqa: N802
        return self

    def containsKey(self, key):  # noqa: N802
        return key in self.held

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value


def test_one_call_takes_many_hashes():
    first = streams._FirstSeen()
    first.init(_Seen())
    part = lambda *rows: pd.DataFrame(rows, columns=["sha256", "row_id", "bucket"])
    call = lambda *parts: [tuple(r) for got in first.handleInputRows((7,), iter(parts), None) for r in got.itertuples(index=False)]
    assert sorted(call(part(("a", 5, 7), ("b", 9, 7), ("a", 3, 7)), part(("c", 1, 7), ("b", 2, 7)))) == [("a", 3), ("b", 2), ("c", 1)]
    assert call(part(("b", 0, 7), ("d", 4, 7))) == [("d", 4)]
