"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once inside a Python worker
BATCH_ROWS = 1000  # rows of one Arrow batch: texts may be long
HOT_KEYS, HOT_ROWS = 10_000, 1000  # a key is hot with more than HOT_ROWS rows and more than one in HOT_KEYS of them


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, one below ``spark.checkpoint.dir`` for each application.

    Only where that is unset on a single machine (tests) a folder beside the
    warehouse is used; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{named}/docsluice/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read back.

    Cuts the lineage: a lost executor costs a re-read of files, never a rerun.
    The table stays until ``discard`` or ``sweep``, as results may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Delete a table of ``stored`` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/docsluice/" in path:
            _delete(table.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application stored. Call it when its results have been read or written."""
    _delete(spark, shared_dir(spark))


def free_names(wanted: tuple[str, ...], taken: list[str]) -> tuple[str, ...]:
    """``wanted`` with underscores until none is a name in ``taken`` (case does not count)."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return tuple(out)


def spread_join(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each key and in ``many`` how many of the ``total`` rows hold it.

    Rows of hot keys meet theirs by broadcast, where they lie: each holds more
    than total / HOT_KEYS rows, so there are fewer than HOT_KEYS of them. All
    others meet by shuffle, where no key brings more than that to a task.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = one.where(F.col("many") > most).drop("many"), one.where(F.col("many") <= most).drop("many")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))


def release(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that executors delete the shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def modest(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    tidy()


def tidy() -> None:
    """Hand freed memory of this worker back to the system; it may sit idle between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches joined until ``column`` holds about ``most`` bytes, then cut as by ``slices``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            whole, held, size = iter([pa.concat_batches(held)]), [], 0
            yield from slices(whole, column, most)
    if held:
        whole, held = iter([pa.concat_batches(held)]), []
        yield from slices(whole, column, most)


def worked(parts: Iterator[pa.RecordBatch], f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``f`` gives for each part. Nothing of a part is held, and its memory is handed back, before the next one is read."""
    for part in parts:
        made = f(part)
        del part
        yield from made
        del made
        tidy()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lowered; null counts as empty.

    Returns all words in one string array and, for each text, how many it has.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return words.filter(real), np.diff(upto[offsets])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor, shift and odd multiplication)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def doc_fold(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(-1))
