"""Exact top-k inner products by vector-approximation files.

Every vector has an approximation: the cell of each component on a uniform
grid of CELLS between the component's extremes over all rows. Two scans of the
approximations bound each score from both sides. The first keeps, in each block
of rows, a query's k highest lower bounds; the best k of them all are read as
exact vectors, and their least exact score is a bound that k candidates reach.
The second scan lets through what may still be as high; these exact vectors are
all that remain in the order of bounds until the kth result is certain, and are
read at once. So a block returns k bounds for a query, then only what exceeds a
bound over all blocks.

Queries and approximations meet in blocks of bounded size, so a task holds one
block of each at a time.

Equal vectors are scanned as one, with the k + 1 rows of theirs that come first,
so copies, however many, add no candidates. As one of the vectors may be the
query's own alone, k + 1 of them make the bound. Rows, not ids, count: several
rows with one id all take part, and a query's own row alone is left out. Defined cases: rows with a null
id, a null vector, or null or non-finite components take no part. Shorter vectors
count as padded with zeros. Fewer than k candidates: all are returned. Ties go to
the smaller id. No queries or no rows: no result. Only the id and the vector are
read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCALE = 64
CELLS = 32
QUERY_BLOCK, ROW_BLOCK = 2048, 65_536
SCORES = 2_000_000  # scores held at once
NONE = float("-inf")


def grid(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least value and cell width of each component, over all rows. A batch of rows gives one row, so no component is exploded."""

    def run(batches):
        for b in batches:
            v = b.column("v")
            if len(v):
                sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
                flat = v.flatten().to_numpy(zero_copy_only=False)
                if (sizes == sizes[0]).all():
                    rows = flat.reshape(len(sizes), -1)
                    low, high = rows.min(axis=0), rows.max(axis=0)
                else:
                    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    low, high = np.full(sizes.max(), np.inf), np.full(sizes.max(), -np.inf)
                    np.minimum.at(low, at, flat)
                    np.maximum.at(high, at, flat)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in (low, high)], names=["low", "high"])

    each = vectors.select("v").mapInArrow(run, "low array<double>, high array<double>")
    got = each.select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "x")).groupBy("i").agg(F.min("x.low").alias("a"), F.max("x.high").alias("z")).collect()
    low, high = np.zeros(len(got)), np.zeros(len(got))
    for r in got:
        low[r["i"]], high[r["i"]] = min(r["a"], 0.0), max(r["z"], 0.0)
    return low, np.maximum(1.0, np.ceil((high - low + 1) / CELLS))


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes, out = pc.list_value_length(column).to_numpy(zero_copy_only=False), np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _approximated(vectors: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            codes = ((_padded(b.column("v"), len(low)) - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "code"])

    return vectors.select("row", "v").mapInArrow(run, "row bigint, code binary")


def _scan(low: np.ndarray, width: np.ndarray, k: int, first: bool):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Of one block of vectors: the ``k`` candidates of each query with the highest lower bounds, or (second scan) those whose upper bound reaches the query's ``floor``."""
        out = []
        if queries.num_rows and rows.num_rows:
            q = _padded(queries.column("v"), len(low))
            qid, cid = queries.column("row").to_numpy(), rows.column("row").to_numpy()
            floor = None if first else queries.column("floor").to_numpy(zero_copy_only=False)
            cells = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(cid), len(low))
            edge = low + cells * width
            small = len(low) * max(np.abs(edge).max(), (np.abs(low) + CELLS * width).max()) * max(1.0, np.abs(q).max()) < 1 << 23
            kind = np.float32 if small else np.float64
            edge = edge.astype(kind).T
            slack = 0.0 if small else 1e-9
            for at in range(0, len(q), max(1, SCORES // len(cid))):
                part = slice(at, at + max(1, SCORES // len(cid)))
                s = q[part].astype(kind) @ edge
                up, down = np.maximum(q[part], 0) @ (width - 1), np.minimum(q[part], 0) @ (width - 1)
                err = slack * (np.abs(q[part]) @ (np.abs(low) + CELLS * width))
                if first:
                    j = np.argpartition(s, len(cid) - k, axis=1)[:, len(cid) - k :].ravel() if len(cid) > k else np.tile(np.arange(len(cid)), len(s))
                    i = np.repeat(np.arange(len(s)), len(j) // len(s))
                    keep = s[i, j] > NONE
                    i, j = i[keep], j[keep]
                else:
                    i, j = np.nonzero((s + (up + err)[:, None] >= floor[part, None]) & (s > NONE))
                out.append((qid[at + i], cid[j], s[i, j] + down[i] - err[i]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "row", "lower"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def top_k(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of floor(scale * x); ties go to the smaller id. ``is_query`` is a condition on the id column named vec_id."""
    x = F.transform(vector, lambda e: e.cast("double"))
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    base = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(sound).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))
    base = stored(base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    queries = base.where(is_query)
    n, m = base.count(), queries.count()
    empty = base.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    if not m or n < 2:
        return empty
    # equal vectors are one candidate; k + 1 of its rows are enough for any query, its own left out
    order = Window.partitionBy("v").orderBy("vec_id", "row")
    few = base.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    vectors = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("row").alias("of")))).alias("members"))
    vectors = stored(vectors.select(F.monotonically_increasing_id().alias("row"), "v", "members"), "distinct")
    low, width = grid(vectors)
    if not len(low):
        low, width = np.zeros(1), np.ones(1)
    rows, cols = max(1, -(-vectors.count() // ROW_BLOCK)), -(-m // QUERY_BLOCK)
    block = lambda c, size: F.pmod(F.xxhash64("row"), F.lit(size)).cast("int").alias(c)
    spread = lambda c, size: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(c)
    cells = stored(_approximated(vectors, low, width), "cells").select("row", "code", block("cb", rows)).select("*", spread("qb", cols))
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    wide = len(low) * float((np.abs(low) + CELLS * width).max()) ** 2 >= 2.0**53
    kind = "decimal(19,0)" if wide else "double"
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a.cast(kind) * b.cast(kind), F.lit(0).cast(kind))), F.lit(0).cast("decimal(38,0)" if wide else "double"), lambda s, e: (s + e).cast("decimal(38,0)" if wide else "double"))

    def scan(some: DataFrame, first: bool, label: str) -> DataFrame:
        left = some.select("*", block("qb", cols)).select("*", spread("cb", rows))
        return stored(left.groupBy("qb", "cb").cogroup(cells.groupBy("qb", "cb")).applyInArrow(_scan(low, width, k + 1, first), "query bigint, row bigint, lower double"), label)

    def read(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors, "row").join(asked, "query").select("query", "row", "query_id", "members", product.cast("bigint").alias("score"))

    by = Window.partitionBy("query")
    near = scan(queries.select("row", "v"), True, "bounds").withColumn("r", F.row_number().over(by.orderBy(F.desc("lower"), "row"))).where(F.col("r") <= k + 1)
    near = stored(read(near.select("query", "row")), "near")
    floor = near.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) == k + 1, F.min("score").cast("double")).alias("floor"))
    may = scan(queries.select("row", "v").join(floor, "row", "left").select("row", "v", F.coalesce("floor", F.lit(NONE)).alias("floor")), False, "candidates")
    rest = may.select("query", "row").join(near.select("query", "row"), ["query", "row"], "left_anti")
    whole = near.unionByName(read(rest)).select("query", "query_id", "score", F.inline("members")).where(F.col("of") != F.col("query"))
    return whole.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 20 == 0)


SQL = """
  WITH sound AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  scored AS (SELECT q.vec_id AS query_id, q.place, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.place <> q.place),
  ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
  SELECT * FROM ranked WHERE rank <= 20"""
