"""Connected components of an edge list, without collecting it.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"). Every minimum is a partial aggregate, so
a node with very many neighbours costs each task one row, and its edges meet the
minimum where they lie; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, stored

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b of one orderable type. Returns (node, label): each node of an edge between different nodes, and the smallest node it reaches.

    Nulls and loops are left out; no edge gives no row.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("many")).select("a", F.least("a", "m").alias("m"), "many")
        large = spread_join(both.where(F.col("b") > F.col("a")), least, "a", before[0])
        large = stored(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("many"))
        small = spread_join(large, least, "a", before[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        spent, now = now, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(large)
        discard(spent)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
