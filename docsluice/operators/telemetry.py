"""Model memory arithmetic over parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIB = float(1 << 30)
#: Model, layers, heads, key/value heads, hidden size, billions of parameters.
MODELS = (
    ("llama3:8b", 32, 32, 8, 4096, 8.03),
    ("phi3:mini", 32, 32, 32, 3072, 3.82),
    ("mistral:7b", 32, 32, 8, 4096, 7.25),
    ("qwen2.5:7b", 28, 28, 4, 3584, 7.61),
)
#: Quantisation, bytes for a weight, accuracy kept, tokens a second, ms to the first token.
QUANTS = (
    ("FP16", 2.00, 100.0, 13.5, 380),
    ("Q8_0", 1.06, 99.7, 26.2, 210),
    ("Q4_K_M", 0.56, 98.4, 43.8, 115),
    ("Q2_K", 0.33, 83.2, 56.4, 85),
)
DEFAULT_MODEL, DEFAULT_QUANT = "llama3:8b", "Q4_K_M"


def _constants(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few literal rows in one partition."""
    names = [f.split(" ") for f in schema.split(", ")]
    lines = [F.struct(*[F.lit(v).cast(kind).alias(n) for v, (n, kind) in zip(r, names, strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*lines)))


def models(spark: SparkSession) -> DataFrame:
    return _constants(spark, MODELS, "model_id string, layers int, heads int, kv_heads int, hidden_dim int, params_b double")


def quants(spark: SparkSession) -> DataFrame:
    return _constants(spark, QUANTS, "quant_type string, bytes_per_weight double, accuracy double, tps_estimate double, ttft_ms int")


def sweep(spark: SparkSession, contexts: list[int], batches: list[int]) -> DataFrame:
    """Every combination of the four parameters (all sides are parameter tables of a few rows)."""
    more = [F.explode(F.array(*[F.lit(x).cast("int") for x in xs])).alias(n) for n, xs in (("context_length", contexts), ("batch_size", batches))]
    out = models(spark).select("model_id").crossJoin(F.broadcast(quants(spark).select("quant_type")))
    for column in more:
        out = out.select("*", column)
    return out


def memory(requests: DataFrame) -> DataFrame:
    """Estimates for requests (model_id, quant_type, context_length, batch_size). Unknown names take the defaults."""
    spark = requests.sparkSession
    known_m, known_q = [m[0] for m in MODELS], [q[0] for q in QUANTS]
    r = requests.select(F.when(F.col("model_id").isin(known_m), F.col("model_id")).otherwise(DEFAULT_MODEL).alias("model_id"), F.when(F.col("quant_type").isin(known_q), F.col("quant_type")).otherwise(DEFAULT_QUANT).alias("quant_type"), "context_length", "batch_size")
    r = r.join(F.broadcast(models(spark)), "model_id").join(F.broadcast(quants(spark)), "quant_type")  # constants of four rows
    weights = F.col("params_b") * 1e9 * F.col("bytes_per_weight") / GIB
    cache = F.lit(4).cast("bigint") * F.col("layers") * F.col("kv_heads") * F.floor(F.col("hidden_dim") / F.col("heads")) * F.col("context_length") * F.col("batch_size") / GIB
    r = r.select("model_id", "quant_type", "context_length", "batch_size", weights.alias("w"), cache.alias("c"), (weights * 0.12).alias("a"), "accuracy", "tps_estimate", "ttft_ms").withColumn("t", F.col("w") + F.col("c") + F.col("a"))
    label = F.when(F.col("t") < 6.5, "Any 8 GiB or 16 GiB Mac").when(F.col("t") < 13.5, "16 GiB Mac").otherwise("32 GiB+ Mac or RTX 3090+")
    return r.select("model_id", "quant_type", "context_length", "batch_size", *[F.round(x, 2).alias(n) for x, n in (("w", "weight_gib"), ("c", "kv_cache_gib"), ("a", "activation_gib"), ("t", "total_gib"))], (F.col("t") < 13.5).alias("fits_16gib"), (F.col("t") < 6.8).alias("fits_8gib"), label.alias("hardware"))
