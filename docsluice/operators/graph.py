"""A stored approximate index of vectors: small-world graphs, segments, tombstones.

Each partition of an add cuts its vectors into shards of SHARD and builds a graph
of each: a node links to its NEAR nearest neighbours and to FAR others drawn by a
fixed seed, so that any node is some steps from any other. A shard is one row.

A search walks the graph of every shard from the best of some fixed entry nodes,
for a block of queries at once: the best node of a query's beam not yet expanded
gives its neighbours, and the best BEAM stay, until all are expanded. Removed
vectors are still passed through, but never returned. A shard that holds no more
vectors than a walk would look at (BEAM times the links of a node: shards of SHARD,
so walks serve larger shards and smaller beams), or one whose walk returns too few,
is scored whole, for a block of queries at once. The best of all
shards are the result; ``recall`` measures it against the flat search.

Defined cases: vectors that are null, empty or hold null, NaN or infinite
components are not taken in. A vec_id that is added again replaces the live one;
of equal ids in one batch the smallest vector is taken. Zero vectors score 0.
Shorter vectors count as padded with zeros. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.batches import Batches
from ..functions.tables import stored
from . import dense

SHARD = 4096
NEAR, FAR, BEAM, ENTRIES = 20, 6, 160, 64
GROUP, QUERY_BLOCK = 16, 512  # shards of a task group, and queries walked at once

SHARDS = "shard bigint, ids array<bigint>, dim int, vectors binary, links binary"
DEAD = "seg string, shard bigint, vec_id bigint"
TOTALS = "n bigint"


# ---- one shard


def linked(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Links of each row of ``x``: nearest others by inner product, then others at random. Rows of few vectors repeat links."""
    n = len(x)
    near = min(NEAR, n - 1)
    out = np.zeros((n, NEAR + FAR), np.int32)
    out[:] = np.arange(n)[:, None]
    y = x.astype(np.float32)
    for a in range(0, n, 512):
        s = y[a : a + 512] @ y.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        if near:
            out[a : a + len(s), :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    if n > 1:
        out[:, NEAR:] = np.random.default_rng(seed).integers(0, n, (n, FAR))
    return out


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and scores in the final beam of each query (row of ``q``); unused places score -inf."""
    n, m = len(x), len(q)
    beam, rows = min(beam, n), np.arange(m)
    entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
    s = q @ x[entries].T
    seen = np.zeros((m, n), bool)
    seen[:, entries] = True
    ids, score, done = np.zeros((m, beam), np.int64), np.full((m, beam), -np.inf, x.dtype), np.zeros((m, beam), bool)
    first = np.argsort(-s, axis=1)[:, : min(beam, len(entries))]
    ids[:, : first.shape[1]], score[:, : first.shape[1]] = entries[first], np.take_along_axis(s, first, 1)
    while True:
        open_ = np.where(done, -np.inf, score)
        j = open_.argmax(axis=1)
        live = rows[open_[rows, j] > -np.inf]
        if not len(live):
            return ids, score
        done[live, j[live]] = True
        near = links[ids[live, j[live]]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        got = np.where(new, np.matmul(x[near], q[live][:, :, None])[:, :, 0], -np.inf)
        # a node that two links name is taken once
        order = np.argsort(near, axis=1, kind="stable")
        again = np.zeros_like(new)
        np.put_along_axis(again, order[:, 1:], np.diff(np.take_along_axis(near, order, 1), axis=1) == 0, 1)
        got[again] = -np.inf
        all_ids, all_score = np.hstack([ids[live], near]), np.hstack([score[live], got]).astype(x.dtype)
        all_done = np.hstack([done[live], np.zeros_like(new)])
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[live], score[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_score, all_done))


def shard_best(row: dict, q: np.ndarray, k: int, beam: int, exact: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of the best live vectors of a shard for each query."""
    ids, dead = np.array(row["ids"], np.int64), set(row["dead"] or ())
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    dim = max(x.shape[1], q.shape[1])
    x, q = (np.pad(a, ((0, 0), (0, dim - a.shape[1]))) for a in (x, q))
    live = np.array([i not in dead for i in ids.tolist()], bool)
    n = int(live.sum())
    want = min(k, n)
    if not want:
        return
    beam = -(-beam * len(ids) // n)
    if exact or n <= beam * (NEAR + FAR):
        places = np.nonzero(live)[0]
        s = q @ x[places].T
        least = np.partition(s, n - want, axis=1)[:, n - want] - dense.CLOSE  # what is near to the kth is kept for ranks by six places
        for i in range(len(q)):
            near = np.nonzero(s[i] >= least[i])[0]
            yield i, ids[places[near]], s[i, near]
        return
    nodes, _ = walk(x.astype(np.float32), np.frombuffer(row["links"], np.int32).reshape(len(ids), -1), q.astype(np.float32), beam)
    for i, v in enumerate(q):
        places = nodes[i][live[nodes[i]]]
        if len(places) < want:
            places = np.nonzero(live)[0]
        s = x[places] @ v
        if len(s) > want:
            least = np.partition(s, len(s) - want)[len(s) - want] - dense.CLOSE
            places, s = places[s >= least], s[s >= least]
        yield i, ids[places], s


# ---- the index


class VectorIndex(Batches):
    """An index of one space in the folder ``path``; other spaces lie beside it and are not read."""

    def __init__(self, spark, path: str, space: str = "local"):
        super().__init__(spark, f"{path}/space={space}")

    def add(self, vectors: DataFrame, batch: str) -> None:
        """Vectors (vec_id, v array<double>) of one batch, as a segment."""
        unit = vectors.where(F.col("vec_id").isNotNull() & ~F.coalesce(V.flawed(F.col("v")), F.lit(True)) & (F.size("v") > 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = stored(unit.select(F.col("vec_id").cast("bigint").alias("vec_id"), V.normalised(F.col("v")).alias("v")), "vectors")
        self.remove(rows.select("vec_id"), f"{batch}-replaced", but=batch)
        self._segment(rows, batch)

    def _segment(self, rows: DataFrame, batch: str) -> None:
        self._write(rows.mapInArrow(_shards, SHARDS).withColumn("shard", F.monotonically_increasing_id()), "add", batch, "shards")
        self._write(rows.agg(F.count(F.lit(1)).alias("n")), "add", batch, "done")

    def remove(self, ids: DataFrame, batch: str, but: str | None = None) -> None:
        """Tombstones for live vectors with the ids (vec_id); unknown ids change nothing. ``but``: a segment that is left alone."""
        held = self._read("add", "shards", SHARDS, but).select(F.col("batch").alias("seg"), "shard", F.explode("ids").alias("vec_id"))
        live = held.join(self.dead(batch), ["seg", "shard", "vec_id"], "left_anti")
        self._write(live.join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select("seg", "shard", "vec_id"), "remove", batch, "ids")
        self._write(self.spark.read.schema(DEAD).parquet(f"{self.path}/remove/{batch}/ids").agg(F.count(F.lit(1)).alias("n")), "remove", batch, "done")

    def dead(self, but: str | None = None) -> DataFrame:
        return self._read("remove", "ids", DEAD, but).select("seg", "shard", "vec_id")

    def _live_shards(self) -> DataFrame:
        """Every shard with the ids that are removed from it, at most SHARD."""
        gone = self.dead().groupBy("seg", "shard").agg(F.collect_set("vec_id").alias("dead"))
        return self._read("add", "shards", SHARDS).withColumnRenamed("batch", "seg").join(gone, ["seg", "shard"], "left")

    def live(self) -> DataFrame:
        """(vec_id, v) of every live vector, of unit length."""
        return self._live_shards().mapInArrow(_unpacked, "vec_id bigint, v array<double>")

    def compacted(self, path: str, space: str = "local", batch: str = "whole") -> VectorIndex:
        """The live vectors as one segment of a new index."""
        out = VectorIndex(self.spark, path, space)
        out._segment(self.live(), batch)
        return out

    def search(self, queries: DataFrame, k: int = dense.TOP, beam: int = BEAM, exact: bool = False) -> DataFrame:
        """(query_id, vec_id, score, rank): about the k highest cosines of queries (query_id, v), by six places, ties by vec_id. ``exact`` scores all live vectors."""
        shards = self._live_shards()
        sound = queries.where(~F.coalesce(V.flawed(F.col("v")), F.lit(True)) & (F.size("v") > 0))
        asked = sound.select(F.col("query_id").cast("bigint").alias("query_id"), V.normalised(F.col("v")).alias("v"))
        groups, blocks = max(1, -(-shards.count() // GROUP)), max(1, -(-asked.count() // (4 * QUERY_BLOCK)))
        spread = lambda name, size: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)
        part = lambda size, *c: F.pmod(F.xxhash64(*c), F.lit(size)).cast("int")
        left = shards.select("ids", "dead", "vectors", "links", part(groups, "seg", "shard").alias("g")).select("*", spread("qb", blocks))
        right = asked.select("query_id", "v", part(blocks, "query_id").alias("qb")).select("*", spread("g", groups))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple] = []
            names = b.column("query_id").to_pylist()
            vectors = b.column("v").to_pylist()
            dim = max(map(len, vectors), default=0)
            held = a.to_pylist()
            for lo in range(0, len(names) if held else 0, QUERY_BLOCK):
                q = np.array([v + [0.0] * (dim - len(v)) for v in vectors[lo : lo + QUERY_BLOCK]])
                found: list[list] = [[] for _ in q]
                for shard in held:
                    for i, ids, s in shard_best(shard, q, k, beam, exact):
                        found[i].append((ids, s))
                for i, parts in enumerate(found):
                    if parts:
                        ids, s = (np.concatenate(p) for p in zip(*parts, strict=True))
                        keep = s >= (np.partition(s, len(s) - k)[len(s) - k] - dense.CLOSE if len(s) > k else -np.inf)
                        out.append((np.full(int(keep.sum()), names[lo + i]), ids[keep], s[keep]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        found = left.groupBy("g", "qb").cogroup(right.groupBy("g", "qb")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    def recall(self, found: DataFrame, queries: DataFrame, k: int = dense.TOP) -> DataFrame:
        """One row: the share of the flat search's results (``dense.vector_top`` over the live vectors) that ``found`` holds; 1 if there is none."""
        flat = dense.vector_top(stored(self.live(), "live"), queries, k)
        hits = flat.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
        return hits.agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(1.0)).alias("recall"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    vectors: list[list[float]] = []
    for b in batches:
        ids += b.column("vec_id").to_pylist()
        vectors += b.column("v").to_pylist()
        while len(ids) >= SHARD:
            yield _shard(ids[:SHARD], vectors[:SHARD])
            ids, vectors = ids[SHARD:], vectors[SHARD:]
    if ids:
        yield _shard(ids, vectors)


def _shard(ids: list[int], vectors: list[list[float]]) -> pa.RecordBatch:
    dim = max(map(len, vectors))
    x = np.array([v + [0.0] * (dim - len(v)) for v in vectors])
    cols = [pa.array([0], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([linked(x).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["shard", "ids", "dim", "vectors", "links"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            x, dead = np.frombuffer(row["vectors"], np.float64).reshape(len(row["ids"]), -1), set(row["dead"] or ())
            keep = [j for j, v in enumerate(row["ids"]) if v not in dead]
            yield pa.RecordBatch.from_arrays([pa.array([row["ids"][j] for j in keep], pa.int64()), pa.array(x[keep].tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])
