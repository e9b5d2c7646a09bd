"""Centroid clustering of integer vectors by filtering kd-trees. Exact: the rounds of plain assignment and floor means, without most of their distances.

Each partition deals its vectors into blocks and builds a kd-tree of each:
nodes hold a count, exact sums and the box of their vectors. The trees are
stored once; every round sends the centroids down them. At a node the candidate
nearest to the box's middle is compared with the others: one that is strictly
farther for every point of the box is pruned. A node with one candidate left is
assigned whole, by its sums; a leaf with several is resolved point by point.
Partial sums meet in Spark, k x dimensions figures in a round reach the driver.

Numbers are whole throughout: doubles while every intermediate is below 2^53,
else Python integers.

Defined cases: rows whose vector is null, has not exactly ``dim`` components, or
holds null, NaN or infinite ones take no part and give no row. Fewer than k
rows: each is a starting centroid. Ties of distance go to the smaller number;
equal starting centroids leave the later one empty, and it stays. Rows with one
id have one hash: among them the smaller vector starts first. A null id is kept
and starts only after all others. Components beyond 2^63 / scale are held at
that bound. Figures beyond a long are null. Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, 2
BLOCK, LEAF = 4096, 24  # vectors of one tree, and of a leaf
LONG = (1 << 63) - 1
SAFE = 1 << 53


def kept(df: DataFrame, key: str, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    c = F.transform(vector, lambda e: e.cast("double"))
    sound = (F.size(vector) == dim) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), F.transform(c, lambda e: F.floor(e * scale)).alias("x"))


def start(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of ``seed:id``."""
    named = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return [list(r["x"]) for r in named.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).select("x").collect()]


# ---- trees


def _tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the rows of ``x`` and nodes (first row, end, left child; the right one follows it; 0: a leaf)."""
    order, nodes, todo = np.arange(len(x)), [(0, len(x), 0)], [0]
    while todo:
        at = todo.pop()
        a, z, _ = nodes[at]
        part = x[order[a:z]]
        if z - a <= LEAF:
            continue
        low, high = part.min(axis=0), part.max(axis=0)
        axis = int(np.argmax(high.astype(float) - low))
        if high[axis] == low[axis]:
            continue
        half = (z - a) // 2
        order[a:z] = order[a:z][np.argpartition(part[:, axis], half)]
        nodes[at] = (a, z, len(nodes))
        todo += [len(nodes), len(nodes) + 1]
        nodes += [(a, a + half, 0), (a + half, z, 0)]
    return order, nodes


TREE = "ids array<bigint>, points binary, width int, nodes binary, low binary, high binary, sums binary"


def _row(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    order, nodes = _tree(x)
    x, spans = x[order], np.array(nodes, np.int32)
    top = max(-int(x.min()), int(x.max()))
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    low, high = (np.array([f(x[a:z], axis=0) for a, z, _ in nodes]) for f in (np.min, np.max))
    sums = np.array([x[a:z].sum(axis=0) for a, z, _ in nodes]) if top * len(x) < 1 << 62 else np.zeros((0, x.shape[1]), np.int64)
    blobs = [x.astype(kind).tobytes(), spans.tobytes(), low.astype(kind).tobytes(), high.astype(kind).tobytes(), sums.astype(np.int64).tobytes()]
    cols = [pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array(blobs[:1], pa.binary()), pa.array([np.dtype(kind).itemsize], pa.int32())]
    return pa.RecordBatch.from_arrays(cols + [pa.array([b], pa.binary()) for b in blobs[1:]], names=["ids", "points", "width", "nodes", "low", "high", "sums"])


def trees(rows: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """One row for each block of vectors of a partition: its kd-tree."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= block:
                whole = pa.concat_batches(held)
                yield _row(whole.column("id").slice(0, block), _matrix(whole.column("x").slice(0, block), dim))
                held, n = [whole.slice(block)], n - block
        if n:
            whole = pa.concat_batches(held)
            yield _row(whole.column("id"), _matrix(whole.column("x"), dim))

    return rows.mapInArrow(run, TREE)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class Tree:
    """A stored tree with numbers of the kind that keeps ``centroids`` exact."""

    def __init__(self, row: dict, centroids: list[list[int]]):
        dim = len(centroids[0])
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]
        read = lambda name, of: np.frombuffer(row[name], of).reshape(-1, dim)
        points, low, high = (read(n, kind) for n in ("points", "low", "high"))
        self.sums = read("sums", np.int64)
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 3)
        top = max(1, -int(points.min()), int(points.max()), *(abs(v) for c in centroids for v in c))
        self.kind = float if 16 * dim * top * top < SAFE else object
        whole = (lambda a: a.astype(float)) if self.kind is float else (lambda a: a.astype(np.int64).astype(object))
        self.points, self.low, self.high = whole(points), whole(low), whole(high)
        self.c = np.array(centroids, dtype=self.kind)
        self.cc = (self.c * self.c).sum(axis=1)
        self.far = float("inf") if self.kind is float else 1 << 200

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ self.c.T) + self.cc

    def assigned(self) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
        """Nodes that go whole to a centroid, as (node, centroid), and points of leaves with theirs, as arrays of places and centroids."""
        whole, single = [], []
        at, open_ = np.zeros(1, np.int64), np.ones((1, len(self.c)), bool)
        while len(at):
            middle = self.low[at] + self.high[at]  # twice the middle
            d = np.where(open_, 4 * self.cc - 4 * (middle @ self.c.T), self.far)
            near = d.argmin(axis=1)
            left = open_.copy()
            for z in np.unique(near):
                mine = near == z
                u = self.c - self.c[z]
                zero = u * 0
                most = self.high[at[mine]] @ np.maximum(u, zero).T + self.low[at[mine]] @ np.minimum(u, zero).T
                left[mine] &= ~(self.cc - self.cc[z] - 2 * most > 0).astype(bool)
            alone = left.sum(axis=1) == 1
            whole += list(zip(at[alone].tolist(), left[alone].argmax(axis=1).tolist(), strict=True))
            at, open_ = at[~alone], left[~alone]
            child = self.nodes[at, 2]
            leaf = child == 0
            if leaf.any():
                spans = self.nodes[at[leaf]]
                size = spans[:, 1] - spans[:, 0]
                places = np.repeat(spans[:, 0] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                d = np.where(np.repeat(open_[leaf], size, axis=0), self._distances(self.points[places]), self.far)
                single.append((places, d.argmin(axis=1).astype(np.int64)))
            child, open_ = child[~leaf], open_[~leaf]
            at, open_ = np.concatenate([child, child + 1]).astype(np.int64), np.concatenate([open_, open_])
        return whole, single

    def totals(self) -> tuple[list[int], list[list[int]]]:
        """Counts and sums of each centroid."""
        k, dim = self.c.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64 if self.kind is float else object)
        whole, single = self.assigned()
        for node, c in whole:
            a, z, _ = self.nodes[node]
            counts[c] += z - a
            sums[c] += self.sums[node] if self.kind is float else self.points[a:z].sum(axis=0)
        for places, c in single:
            counts += np.bincount(c, minlength=k)
            if self.kind is float:  # sums of a block stay below 2^53 where distances do
                one = np.zeros((k, len(c)))
                one[c, np.arange(len(c))] = 1
                sums += (one @ self.points[places]).astype(np.int64)
            else:
                for i in np.unique(c):
                    sums[i] += self.points[places[c == i]].sum(axis=0)
        return counts.tolist(), [[int(v) for v in row] for row in sums]

    def labels(self) -> tuple[np.ndarray, list[int]]:
        """The centroid of every point, and its squared distance."""
        out = np.zeros(len(self.points), np.int64)
        whole, single = self.assigned()
        for node, c in whole:
            a, z, _ = self.nodes[node]
            out[a:z] = c
        for places, c in single:
            out[places] = c
        diff = self.points - self.c[out]
        return out, [int(v) for v in (diff * diff).sum(axis=1)]


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def moved(forest: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: floor means of what is nearest to each centroid; empty ones stay."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches):
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        for b in batches:
            for row in _each(b):
                n, s = Tree(row, centroids).totals()
                counts = [a + v for a, v in zip(counts, n, strict=True)]
                sums = [[a + v for a, v in zip(x, y, strict=True)] for x, y in zip(sums, s, strict=True)]
        used = [c for c in range(k) if counts[c]]
        cells = [(c, i, v) for c in used for i, v in enumerate((counts[c], *sums[c]))]
        cols = list(zip(*cells, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([Decimal(v) for v in cols[2]], pa.decimal128(38, 0))], names=["c", "i", "v"])

    got: dict[int, dict[int, int]] = {}
    for r in forest.mapInArrow(run, "c int, i int, v decimal(38,0)").groupBy("c", "i").agg(F.sum("v").alias("v")).collect():
        got.setdefault(r["c"], {})[r["i"]] = int(r["v"])
    return [[got[c][i + 1] // got[c][0] for i in range(dim)] if c in got else old for c, old in enumerate(centroids)]


def clustered(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, and the final centroids."""
    rows = kept(df, key, vector, dim, scale)
    centroids = start(rows, k, seed)
    if not centroids:
        return df.sparkSession.createDataFrame([], "id bigint, cluster int, distance bigint"), []
    forest = stored(trees(rows, dim, block), "trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    final = centroids

    def run(batches):
        for b in batches:
            for row in _each(b):
                c, d = Tree(row, final).labels()
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(c, pa.int32()), pa.array([v if v <= LONG else None for v in d], pa.int64())], names=["id", "cluster", "distance"])

    return stored(forest.mapInArrow(run, "id bigint, cluster int, distance bigint"), "clusters"), final


def embedding_clusters(embeddings: DataFrame) -> DataFrame:
    """op13: each kept vector with its cluster, distance and the inertias."""
    rows, centroids = clustered(embeddings)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = embeddings.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c).cast("decimal(38,0)")))
    each = rows.groupBy("cluster").agg(total("distance").alias("own"))
    whole = each.agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("all"))
    # at most k rows on the right
    right = each.crossJoin(F.broadcast(whole)).join(F.broadcast(named), "cluster")
    right = right.select("cluster", F.expr("try_cast(own as bigint)").alias("cluster_inertia"), F.expr("try_cast(all as bigint)").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(right), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The plain rounds: every distance, in every round."""
    steps = [
        f"""v as (select vec_id, row_number() over () as r, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as x from embeddings
            where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM})""",
        f"""c0 as (select cast(row_number() over (order by h, x) - 1 as integer) as cluster, x as c from
            (select x, sha256('{SEED}:' || cast(vec_id as varchar)) as h from v order by h nulls last, x limit {K}))""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as (select r, vec_id, x, d[1] as distance, cast(d[2] as integer) as cluster from (select r, any_value(vec_id) as vec_id, any_value(x) as x,
            min([cast(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint), cast(cluster as bigint)]) as d from v cross join c{i} group by r))""")
        if i < ROUNDS:
            steps.append(f"""m{i} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from
                (select cluster, i, sum(x[i]) as s, count(*) as n from a{i}, range(1, {DIM + 1}) as g(i) group by cluster, i) group by cluster)""")
            steps.append(f"c{i + 1} as (select o.cluster, coalesce(m.c, o.c) as c from c{i} o left join m{i} m on m.cluster = o.cluster)")
    return f"""with {", ".join(steps)} select vec_id, a.cluster, distance, cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia,
        cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.cluster = a.cluster"""


SQL = _sql()
