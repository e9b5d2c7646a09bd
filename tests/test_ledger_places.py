"""Verification by position, over many ranges, against a plain loop."""

import random

from pyspark.sql import functions as F

from docsluice.operators import ledger


def plain(rows):
    """rows: (place, idx, ts, kind, data hash, previous, current) of one ledger."""
    last = ledger.GENESIS
    for i, (_, idx, ts, kind, data, previous, current) in enumerate(rows):
        import hashlib

        if previous != last or current != hashlib.sha256(f"{idx}:{ts}:{kind}:{data}:{previous}".encode()).hexdigest():
            return i
        last = current
    return -1


def test_repeats_gaps_and_swaps_are_found_over_many_ranges(spark):
    events = spark.range(900).select((F.col("id") % 9).alias("ledger"), F.floor(F.col("id") / 9).alias("idx"), F.concat(F.lit("t"), F.col("id")).alias("ts"), F.lit("ERROR").alias("event_type"), F.lit("s").alias("payload_summary"), F.sha2(F.col("id").cast("string"), 256).alias("data_hash"))
    chain = ledger.chained(events.where("ledger < 8 or idx < 1")).collect()
    r, rows = random.Random(5), []
    for x in chain:
        k, i = x["ledger"], x["idx"]
        row = [k, i, i, x["ts"], x["event_type"], x["payload_summary"], x["data_hash"], x["previous_hash"], x["current_hash"]]
        if k == 2 and i == 50:
            continue  # missing
        if k == 3 and i in (98, 99):
            row[1] = 197 - i  # swapped at the end
        if k == 4 and i == 0:
            row[7] = "1" * 64
        if k == 5 and i == 77:
            row[6] = "0" * 64
        if k == 6 and i == 99:
            row[8] = None
        rows += [row, list(row)] if k == 1 and i == 33 else [row]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "ledger bigint, place bigint, idx bigint, ts string, event_type string, payload_summary string, data_hash string, previous_hash string, current_hash string")
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = {x["ledger"]: (x["valid"], x["first_bad"], x["n"]) for x in ledger.verified(df, place="place").collect()}
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    for k in range(9):
        mine = sorted((x[1], x[2], x[3], x[4], x[6], x[7], x[8]) for x in rows if x[0] == k) if k != 6 else sorted(((x[1], x[2], x[3], x[4], x[6], x[7], x[8] or "") for x in rows if x[0] == k))
        bad = plain(mine)
        assert got[k] == (bad == -1, bad, len(mine)), k
    assert {k: got[k][1] for k in (0, 1, 2, 3, 4, 5, 6, 7, 8)} == {0: -1, 1: 34, 2: 50, 3: 98, 4: 0, 5: 77, 6: 99, 7: -1, 8: -1}
    assert ledger.verified(df.limit(0)).collect() == []
