"""Sinks: tables with a manifest, small files whole or not at all, merged text reports."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection


def write_bytes(path: str, data: bytes, mode: int = 0o644) -> None:
    """Write beside the target, sync, rename; nothing is left behind on failure. For the driver's own small files."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, mode)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def write_json(path: str, value) -> None:
    write_bytes(path, json.dumps(value, indent=2, sort_keys=True).encode())


def read_json(path: str, default=None):
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def snapshot(docs: DataFrame, chunks: DataFrame, path: str) -> str:
    """Documents, chunks and then their manifest in a new folder below ``path``; returns its name.

    Names go by time. The manifest comes last, so a folder without one was cut
    short and is no version; older versions stay as they are.
    """
    version = f"v{time.time_ns():020d}"
    spark, at = chunks.sparkSession, f"{path}/{version}"
    docs.write.parquet(f"{at}/documents")
    chunks.write.parquet(f"{at}/chunks")
    collection.manifest(spark.read.parquet(f"{at}/chunks")).write.parquet(f"{at}/manifest")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions below ``path``, oldest first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/manifest/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(f.getPath().getParent().getParent().getName() for f in found)


def restore_snapshot(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a version (the last whole one), if its manifest holds; else ValueError. Nothing is deleted."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"{path} holds no such version")
    at = f"{path}/{version or known[-1]}"
    docs, chunks = (spark.read.parquet(f"{at}/{n}") for n in ("documents", "chunks"))
    if not all(collection.manifest_holds(chunks, spark.read.parquet(f"{at}/manifest")).first()):
        raise ValueError(f"the manifest of {at} does not match its tables")
    return docs, chunks


def vectors(df: DataFrame, path: str, space: str, buckets: int = 16) -> None:
    """Vectors of one space, partitioned by space and a bucket of the id."""
    df.withColumn("space", F.lit(space)).withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))).write.mode("append").partitionBy("space", "bucket").parquet(path)


def read_vectors(spark: SparkSession, path: str, space: str) -> DataFrame:
    """Vectors of one space, as ``vectors`` wrote them; other spaces are not read."""
    return spark.read.parquet(path).where(F.col("space") == space).drop("space", "bucket")


def merged_report(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, lines, chars, section) of each text file, to be written in the order of name."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")
    lines = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))) + 1
    return files.select("name", lines.alias("lines"), F.length("value").alias("chars"), F.concat(F.lit("=== "), "name", F.lit(" ===\n"), "value", F.lit("\n")).alias("section"))
