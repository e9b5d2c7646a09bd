"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``, one for each application. Only on a single machine (tests) may that be unset: then beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{named}/docsluice-core/{spark.sparkContext.applicationId}"


FILE_ROWS = 1 << 16  # of one stored file


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for what several later steps read. A lost executor costs a re-read of files.

    Files are small enough that what a few tasks have written is read by more,
    without a shuffle.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key (null too) no other row has, and the rest, or None if there is no rest. The keys are read once beforehand."""
    again = stored(rows.groupBy(F.col(key).alias("again_")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again_"), "again")
    if again.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("again_"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def sweep(spark: SparkSession) -> None:
    """Delete what this application stored. Call it when its results have been read or written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
