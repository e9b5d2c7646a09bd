"""Embedding whitening: leading eigenvectors of the covariance by matrix-free block Lanczos.

The covariance is never formed. Every pass reads the fit list once: each
partition centres its rows and gives Xt(XQ) for the block Q, Spark adds the
partitions' sums, and the driver holds the basis and its products, at most
``most`` columns of one vector's length. A new block is orthogonalised against
the whole basis, twice. Directions that break down, as the block lies in the
space found already, start again from random ones; a full basis is cut to its
best Ritz vectors and goes on from the same block. The end is reached when the
residual |Ve - ey| of every wanted pair is TOLERANCE of the largest eigenvalue,
or when the basis spans the whole space.

The trace comes from the exact deviations, so shares need no further
eigenvalues. All other columns of the input are ignored, whatever their names.

Defined cases: rows with a null vector, or with null, NaN or infinite entries,
take no part and give no row. Shorter vectors count as padded with zeros, an
empty one as zeros. Entries beyond 2^63 / scale are held at that bound. Repeated
vectors, and vectors that scale to the same integers, enter the fit once and
each of their rows gets its figures. Components without variance do not exist:
with equal vectors, one row or none the result is empty. Equal eigenvalues: some
orthonormal basis of their space, the same for all rows. A null id is kept.
``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
COMPONENTS = 4
BLOCK = 8
BASIS = 160  # columns of the basis at most
PASSES = 400
TOLERANCE = 2e-15
STALLED = 1e-11  # residual that is good enough once it no longer falls
LONG = (1 << 63) - 1


@dataclass
class Centre:
    """Count and exact sums of the fit list, as whole means and what is left over."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """x minus the whole means: exact."""
        return x - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, each entry as exact as a double can be."""
        if x.size and max(-int(x.min()), int(x.max())) >= 1 << 61:
            return x.astype(float) - self.whole - self.rest / self.n
        return self.shifted(x) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2 = n*n*yy - 2*n*yr + rr for y = x - whole, in whole numbers."""
        n, r = self.n, self.rest
        y = x.astype(object) - self.whole.astype(object) if x.size and max(-int(x.min()), int(x.max())) >= 1 << 61 else self.shifted(x)
        top = max(1, max(-int(y.min()), int(y.max())) if y.size else 1)
        if len(r) * top * max(top, n) >= 1 << 62:
            y, r = y.astype(object), r.astype(object)
        yy, yr, rr = (y * y).sum(axis=1), (y * r).sum(axis=1), sum(int(v) ** 2 for v in r)
        return [n * n * int(a) - 2 * n * int(b) + rr for a, b in zip(yy, yr, strict=True)]


@dataclass
class Whitening:
    centre: Centre
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column each
    identity_error: float
    passes: int


def scaled(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * entry) of every sound vector."""
    c = F.transform(vector, lambda e: e.cast("double"))
    sound = F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    return df.where(sound).select(F.col(key).cast("bigint").alias("id"), F.transform(c, lambda e: F.floor(e * scale)).alias("x"))


def padded(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with all x of one length, and that length."""
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least is not None and least < most:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(most) - F.size("x"))))
    return rows, most or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _summed(rows: DataFrame, kind: str, f: Callable[[Iterator[np.ndarray]], list], dim: int) -> list:
    """The figures that ``f`` gives for each partition's matrices, added up by place."""
    arrow = {"double": pa.float64(), "decimal(38,0)": pa.decimal128(38, 0)}[kind]

    def run(batches):
        got = f(matrix(b.column("x"), dim) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), pa.array(got, arrow)], names=["i", "v"])

    return [r["v"] for r in rows.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]


def centre_of(fit: DataFrame, dim: int) -> Centre | None:
    def f(parts):
        n, sums = 0, [0] * dim
        for x in parts:
            wide = x.size and max(-int(x.min()), int(x.max())) >= (1 << 62) // len(x)
            sums = [a + int(b) for a, b in zip(sums, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
            n += len(x)
        return [Decimal(v) for v in (n, *sums)]

    n, *sums = (int(v) for v in _summed(fit, "decimal(38,0)", f, dim)) if dim else (0,)
    return Centre.of(n, sums) if n else None


def product(fit: DataFrame, c: Centre, q: np.ndarray) -> np.ndarray:
    """V q in one pass."""
    dim = len(q)

    def f(parts):
        total = np.zeros(q.shape)
        for x in parts:
            y = c.centred(x)
            total += y.T @ (y @ q)
        return total.ravel()

    return np.array(_summed(fit, "double", f, dim)).reshape(q.shape) / c.n


def trace_of(fit: DataFrame, c: Centre) -> float:
    f = lambda parts: [math.fsum(d / c.n**2 for x in parts for d in c.deviations(x))]
    return _summed(fit, "double", f, len(c.whole))[0] / c.n


def identity_error(fit: DataFrame, c: Centre, axes: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = axes.shape[1]

    def f(parts):
        first, second = np.zeros(k), np.zeros((k, k))
        for x in parts:
            z = c.centred(x) @ axes
            first += z.sum(axis=0)
            second += z.T @ z
        return np.concatenate([first, second.ravel()])

    got = np.array(_summed(fit, "double", f, len(axes))) / c.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def _orthogonal(basis: np.ndarray, block: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """The directions of ``block`` beyond ``basis``, orthonormal; a direction that breaks down starts again at random."""
    out = basis[:, :0]
    for column in block.T:
        known = np.hstack([basis, out])
        if known.shape[1] == len(basis):
            break
        size = scale
        for _ in range(8):
            for _ in range(2):  # twice is enough
                column = column - known @ (known.T @ column)
            left = float(np.linalg.norm(column))
            if left > 1e-10 * size:
                column = column / left
                column = column - known @ (known.T @ column)
                out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
                break
            column, size = rng.standard_normal(len(basis)), math.sqrt(len(basis))
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, want: int, block: int = BLOCK, most: int = BASIS) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``want`` largest eigenvalues of a symmetric operator, their unit vectors as columns, and the passes taken.

    ``apply`` gives the operator's product with a block of columns.
    """
    rng = np.random.default_rng(20)
    want, block = min(want, dim), min(max(block, want), dim)
    most = max(most, 2 * want + 3 * block)
    u, w = np.zeros((dim, 0)), np.zeros((dim, 0))
    q = _orthogonal(u, rng.standard_normal((dim, block)), math.sqrt(dim), rng)
    best, stalled = math.inf, 0
    for passes in range(1, PASSES + 1):
        u, w = np.hstack([u, q]), np.hstack([w, apply(q)])
        t = u.T @ w
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        y, vy = u @ s[:, :want], w @ s[:, :want]
        worst = float(np.linalg.norm(vy - y * values[:want], axis=0).max()) if u.shape[1] >= want else math.inf
        top = max(float(values[0]), 0.0)
        stalled = 0 if worst < 0.5 * best else stalled + 1
        best = min(best, worst)
        if worst <= TOLERANCE * top or u.shape[1] == dim or (stalled > 3 and worst <= STALLED * top):
            return values[:want], y / np.linalg.norm(y, axis=0), passes
        size = float(np.linalg.norm(w[:, -q.shape[1] :], axis=0).max())
        q = _orthogonal(u, w[:, -q.shape[1] :], max(size, 1e-300), rng)
        if u.shape[1] + q.shape[1] > most:  # cut to the best Ritz vectors; the residuals of all lie in q
            keep = want + block
            u, w = u @ s[:, :keep], w @ s[:, :keep]
    raise RuntimeError(f"no convergence in {PASSES} passes: residual {worst:.3g} of {top:.3g}")


def fit_whitening(rows: DataFrame, dim: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Fit on the distinct x of ``rows`` (all of length ``dim``). None if nothing varies."""
    fit = stored(rows.select("x").distinct(), "fit")
    c = centre_of(fit, dim)
    if c is None:
        return None
    trace = trace_of(fit, c)
    if not trace > 0:
        return None
    values, vectors, passes = lanczos(lambda q: product(fit, c, q), dim, components, block)
    real = values > 64 * dim * np.finfo(float).eps * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(values))] < 0, -1.0, 1.0)
    return Whitening(c, trace, values, vectors, identity_error(fit, c, vectors / np.sqrt(values)), passes)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error): one row for each sound row of ``df``."""
    rows, dim = padded(scaled(df, key, vector, scale))
    schema = "id bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    m = fit_whitening(rows, dim, components, block)
    if m is None:
        return df.sparkSession.createDataFrame([], schema)
    c, axes, shares = m.centre, m.vectors / np.sqrt(m.values), (m.values / m.trace).tolist()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), dim)
                z = c.centred(x) @ axes
                offsets = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([d if d <= LONG else None for d in c.deviations(x)], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))],
                    names=["id", "deviation", "whitened"],
                )

    out = rows.mapInArrow(run, "id bigint, deviation bigint, whitened array<double>")
    return out.select("id", F.lit(c.n).cast("bigint").alias("n"), "deviation", "whitened", F.array(*map(F.lit, shares)).alias("explained"), F.lit(m.identity_error).alias("identity_error"))


def embedding_whitening(embeddings: DataFrame) -> DataFrame:
    """op11: a row for each remaining row and component."""
    rows = whitened(embeddings).select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "z"))
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "z.whitened", "z.explained", "identity_error")
