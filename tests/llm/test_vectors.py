"""Whitening and clustering against plain versions of themselves, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from docsluice.llm import centroids, whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, cluster string, n string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "c", "n") for i, v in rows], SCHEMA).repartition(parts)


def sound(v):
    return v is not None and all(e is not None and math.isfinite(e) for e in v)


# ---- whitening


def plain_whitening(rows, want=4):
    rows = [(i, v) for i, v in rows if sound(v)]
    dim = max(len(v) for _, v in rows)
    xs = [(i, [math.floor(256 * e) for e in v] + [0] * (dim - len(v))) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * e - t) / n for e, t in zip(x, s, strict=True)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:want], vectors[:, ::-1][:, :want]
    real = values > 1e-12 * values[0]
    out = []
    for i, x in xs:
        dev = sum((n * e - t) ** 2 for e, t in zip(x, s, strict=True))
        z = np.array([(n * e - t) / n for e, t in zip(x, s, strict=True)]) @ vectors[:, real] / np.sqrt(values[real])
        out.append((i, dev, z))
    return n, np.trace(v), values[real], out


def check_whitening(spark, rows, want=4, close=1e-9):
    got = whitening.embedding_whitening(frame(spark, rows)).collect()
    n, trace, values, expected = plain_whitening(rows, want)
    assert len(got) == len(expected) * len(values)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-8
    by: dict = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    signs = {}
    for i, dev, z in expected:
        mine = sorted(by[i, dev], key=lambda r: r["component"])
        for c, value in enumerate(z):
            r = mine[c * (len(mine) // len(z))]
            if c not in signs and abs(value) > 1e-3:
                signs[c] = math.copysign(1, value * r["whitened"])
            assert r["whitened"] == pytest.approx(signs.get(c, 1) * value, abs=close)
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((300, 24)) * np.linspace(3, 0.1, 24) + np.linspace(-5, 5, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of the rows are copies and count once
    check_whitening(spark, rows)


def test_whitening_edges(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(40)]
    rows += [(50, None), (51, [1.0, None, 1.0]), (52, [NAN] * 6), (53, [INF] + [0.0] * 5), (54, [0.5, -0.5]), (55, []), (None, [0.25] * 6), (3, rows[3][1]), (3, rows[4][1]), (56, [-0.0] * 6)]
    got = whitening.embedding_whitening(frame(spark, rows)).collect()
    assert {x["vec_id"] for x in got} == {*range(40), 54, 55, 56, None} and len(got) == 4 * sum(sound(v) for _, v in rows)
    assert {x["deviation"] for x in got if x["vec_id"] == 55} == {x["deviation"] for x in got if x["vec_id"] == 56}
    check_whitening(spark, [x for x in rows if x[0] is not None])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.embedding_whitening(frame(spark, rows)).collect() == []


def test_whitening_of_few_dimensions_and_far_off_means(spark):
    line = [(i, [1e6 + i * 0.01, 2e6 + i * 0.02]) for i in range(50)]
    check_whitening(spark, line, close=1e-5)
    got = whitening.embedding_whitening(frame(spark, [(1, [1.0]), (2, [3.0]), (3, [5.0])])).collect()
    assert [r["component"] for r in got] == [1, 1, 1] and got[0]["explained"] == pytest.approx(1)
    assert sorted(abs(r["whitened"]) for r in got) == pytest.approx([0, math.sqrt(1.5), math.sqrt(1.5)])
    huge = whitening.embedding_whitening(frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 5.0])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 2} == {None} and len(huge) >= 3


@pytest.mark.parametrize("dim,rank,most", [(300, 300, 60), (200, 3, 160), (64, 64, 160), (1, 1, 160), (500, 40, 50)])
def test_lanczos_restarts_and_breakdown(dim, rank, most):
    r = np.random.default_rng(dim)
    q, _ = np.linalg.qr(r.standard_normal((dim, rank)))
    values = np.sort(r.uniform(0, 1, rank))[::-1]
    values[:2] = 1.5  # an equal pair
    a = (q * values) @ q.T
    calls = []
    got, vectors, passes = whitening.lanczos(lambda b: calls.append(b.shape) or a @ b, dim, 4, 8, most)
    assert len(calls) == passes
    wanted = np.concatenate([values, np.zeros(4)])[: len(got)]
    assert got == pytest.approx(wanted, abs=1e-11)
    assert np.abs(a @ vectors - vectors * got).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12


# ---- clustering


def plain_clusters(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * e) for e in v]) for i, v in rows if sound(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        labels = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), at in zip(kept, labels, strict=True) if at == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    final = [near(x) for _, x in kept]
    own = {}
    for d, j in final:
        own[j] = own.get(j, 0) + d
    name = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted(((i, j, d, own[j], sum(own.values()), name(j)) for (i, _), (d, j) in zip(kept, final, strict=True)), key=str)


def clusters(spark, rows):
    return sorted((tuple(r) for r in centroids.embedding_clusters(frame(spark, rows)).collect()), key=str)


def test_clusters_equal_plain_rounds(spark):
    r = np.random.default_rng(6)
    centre = r.standard_normal((12, 64))
    rows = [(i, (centre[i % 12] + 0.3 * r.standard_normal(64)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a third are copies
    rows += [(2000, None), (2001, [0.0] * 63), (2002, [0.0] * 65), (2003, [NAN] * 64), (2004, [0.0] * 63 + [None]), (2005, [INF] * 64), (None, [0.1] * 64), (7, rows[8][1]), (7, rows[7][1])]
    assert clusters(spark, rows) == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 41])
def test_few_clusters_and_ties(spark, n):
    rows = [(i, [float(i % 2)] * 64) for i in range(n)]  # equal starts: later ones stay empty
    assert clusters(spark, rows) == plain_clusters(rows)


def test_clusters_of_large_components(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * 4e5 for _ in range(64)]) for i in range(60)]  # beyond 2^53 in the sums
    assert clusters(spark, rows) == plain_clusters(rows)
    far = centroids.embedding_clusters(frame(spark, [(i, [1e300 * (-1) ** i] * 64) for i in range(50)])).collect()
    assert len(far) == 50


def test_trees_prune_and_stay_exact():
    r = np.random.default_rng(9)
    points = np.concatenate([r.integers(-3, 3, (500, 4)) + 40 * np.array([i, -i, 0, i]) for i in range(6)])
    row = centroids._row(pa.array(range(len(points))), points.astype(np.int64)).to_pylist()[0]
    c = [[40 * i, -40 * i, 0, 40 * i] for i in range(6)] + [[0, 0, 0, 0], [1, 0, 0, 0]]
    tree = centroids.Tree(row, c)
    whole, single = tree.assigned()
    labels, d = tree.labels()
    dist = ((points[:, None, :] - np.array(c)) ** 2).sum(axis=2)
    at = np.array(row["ids"])
    assert (labels == dist.argmin(axis=1)[at]).all() and d == dist.min(axis=1)[at].tolist()
    assert sum(int(tree.nodes[n, 1] - tree.nodes[n, 0]) for n, _ in whole) > len(points) * 0.7  # most go by whole nodes
    wide = centroids.Tree(row, [[v + (1 << 40) * (i == 7) for v in m] for i, m in enumerate(c)])
    assert wide.kind is object and wide.totals()[0][:7] == [int((wide.labels()[0] == i).sum()) for i in range(7)]


# ---- exact top-k: copies


def test_copies_add_no_candidates(spark, monkeypatch):
    from docsluice.llm import vafile

    made = {}
    real = vafile.stored
    monkeypatch.setattr(vafile, "stored", lambda df, label: made.setdefault(label, real(df, label)))
    r = np.random.default_rng(2)
    same = r.standard_normal(8).round(2).tolist()
    rows = [(i, same) for i in range(2000)] + [(i, r.standard_normal(8).round(2).tolist()) for i in range(2000, 2300)] + [(40, same), (2040, same)]
    got = vafile.embedding_neighbours(frame(spark, rows)).collect()
    assert made["candidates"].count() < 60 * 116 and made["distinct"].count() == 301
    x = [(i, [math.floor(64 * e) for e in v]) for i, v in rows]
    want = []
    for p, (i, v) in enumerate(x):
        if i % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for o, (j, w) in enumerate(x) if o != p))[:20]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
