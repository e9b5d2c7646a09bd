"""Tables that grow by named batches, in a folder that driver and executors share.

Every write goes to a folder named by its kind and batch and counts once its
``done`` part stands; a batch that runs again overwrites its folder, so a job
that is repeated after a failure changes nothing. Writers take turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Batches:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        """Batches of one kind that are whole."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/done/_SUCCESS")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(f.getPath().getParent().getParent().getName() for f in found)

    def _read(self, kind: str, part: str, schema: str, but: str | None = None) -> DataFrame:
        """One part of all whole batches of a kind, save ``but``, with the batch's name."""
        names = [n for n in self._names(kind) if n != but]
        if not names:
            return self.spark.createDataFrame([], f"{schema}, batch string")
        out = None
        for name in names:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{name}/{part}").withColumn("batch", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _write(self, df: DataFrame, kind: str, batch: str, part: str, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{kind}/{batch}/{part}")
        self.spark.sparkContext._jvm.System.gc()  # what the driver no longer refers to lets executors delete the shuffle files of finished steps
