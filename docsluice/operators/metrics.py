"""Evaluation metrics: nearest-rank percentiles, accuracy, corpus fingerprints, risk bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


CUTS = 64


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """For each group and named share p the value at 0-based place min(int(n * p), n - 1); not interpolated.

    Equal values are counted first. Approximate quantiles cut a group into
    buckets; only those that hold a place that is asked for are ranked, so no
    task ranks a whole group, however many distinct values it has.
    """
    rows = df.where(F.col(value).isNotNull())
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")).join(cuts, by)
    counts = counts.select(*by, value, "c", "n", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("bucket"))
    totals = counts.groupBy(*by, "bucket", "n").agg(F.sum("c").alias("t"))
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("z", F.sum("t").over(upto)).withColumn("a", F.col("z") - F.col("t"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("place")) for k, p in shares.items()]))
    wanted = totals.select(*by, "bucket", "a", "z", asked.alias("x")).where((F.col("x.place") >= F.col("a")) & (F.col("x.place") < F.col("z"))).select(*by, "bucket", "a", "x.name", "x.place")
    inside = Window.partitionBy(*by, "bucket", "name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(wanted, [*by, "bucket"]).withColumn("upto", F.col("a") + F.sum("c").over(inside)).where(F.col("upto") > F.col("place"))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("name") == k, F.col(value))).alias(k) for k in shares])


def accuracy(results: DataFrame, expected: str, got: str) -> DataFrame:
    """Matches, total and percentage; a missing result is no match."""
    hit = F.coalesce(F.col(expected) == F.col(got), F.lit(False))
    return results.agg(F.count_if(hit).alias("matches"), F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg(F.when(hit, 100.0).otherwise(0.0)), F.lit(0.0)), 2).alias("accuracy"))


def fingerprint(texts: DataFrame, key: str, text: str) -> DataFrame:
    """16 hex digits over the texts' hashes in the order of ``key``. Hashes, not texts, meet in one row for each bucket of keys."""
    each = texts.select(F.col(key).alias("k"), F.sha2(text, 256).alias("h")).withColumn("b", F.floor(F.col("k") / 1000))
    part = each.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return part.agg(F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256), F.lit(16)).alias("corpus_hash"), F.count(F.lit(1)).alias("buckets"))


def risk_band(score: Column) -> Column:
    return F.when(score > 60, "HIGH").when(score > 25, "MEDIUM").otherwise("LOW")
