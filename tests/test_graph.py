"""The stored vector index against the flat search, through adds, replacements, removals, reruns and compaction."""

import numpy as np
import pytest

from docsluice.operators import dense, graph

SCHEMA = "vec_id bigint, v array<double>"
NAN = float("nan")


def clustered(n, dim=24, seed=1, first=0):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((12, dim))
    return [(first + i, (centre[i % 12] + 0.4 * r.standard_normal(dim)).tolist()) for i in range(n)]


def top(rows):
    return sorted(map(tuple, rows.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 600)
    return graph.VectorIndex(spark, str(tmp_path / "vectors"))


def test_index_follows_adds_and_removals(spark, index):
    one, two = clustered(1500), clustered(300, seed=2, first=1400)  # two replaces a hundred
    queries = spark.createDataFrame([(i, v) for i, v in one[::40]] + [(9000, None), (9001, [NAN] * 24), (9002, [])], "query_id bigint, v array<double>")
    held = dict(one)

    def check():
        flat = top(dense.vector_top(spark.createDataFrame(sorted(held.items()), SCHEMA), queries.where("query_id < 9000"), 10))
        assert top(index.search(queries, 10, exact=True)) == flat
        found = index.search(queries, 10, beam=60)
        assert index.recall(found, queries.where("query_id < 9000"), 10).first()["recall"] >= 0.9
        assert {r["vec_id"] for r in found.collect()} <= set(held)
        return top(found)

    assert top(index.search(queries, 10)) == [] and index.recall(index.search(queries), queries.where("query_id < 9000")).first()["recall"] == 1
    index.add(spark.createDataFrame(one, SCHEMA).coalesce(2), "a")
    check()
    for _ in range(2):  # a batch that runs again
        index.add(spark.createDataFrame(two + two[:5] + [(1, None), (2, [NAN] * 24), (None, [1.0] * 24), (3, [])], SCHEMA).coalesce(1), "b")
    held |= dict(two)
    check()
    for _ in range(2):
        index.remove(spark.createDataFrame([(i,) for i in range(0, 1700, 4)] + [(123456,)], "vec_id bigint"), "x")
    held = {i: v for i, v in held.items() if i % 4 or i >= 1700}
    check()
    index = index.compacted(index.path + "-new")
    assert {r["vec_id"] for r in index.live().collect()} == set(held) and index.dead().count() == 0
    check()


def test_spaces_stay_apart_and_small_ones_are_exact(spark, tmp_path):
    local, cloud = (graph.VectorIndex(spark, str(tmp_path), s) for s in ("local", "cloud"))
    local.add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], SCHEMA), "a")
    cloud.add(spark.createDataFrame([(7, [1.0, 0.0, 0.0])], SCHEMA), "a")
    q = spark.createDataFrame([(5, [3.0, 0.0])], "query_id bigint, v array<double>")
    assert top(local.search(q)) == [(5, 1, 1, 1.0), (5, 2, 4, 1.0), (5, 3, 2, 0.0), (5, 4, 3, 0.0)]
    assert top(cloud.search(q)) == [(5, 1, 7, 1.0)]
    local.remove(spark.createDataFrame([(1,), (2,), (3,), (4,)], "vec_id bigint"), "r")
    assert top(local.search(q)) == []


def test_walk_finds_neighbours_without_scoring_all():
    x = np.array([v for _, v in clustered(3000)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, s = graph.walk(x, graph.linked(x), x[::50], 80)
    flat = np.argsort(-(x[::50] @ x.T), axis=1)[:, :10]
    got = np.take_along_axis(ids, np.argsort(-s, axis=1)[:, :10], 1)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(flat.tolist(), got.tolist(), strict=True)]) > 0.9
    assert all(len(set(i)) == len(i) for i in ids.tolist())
    for n in (1, 2, 5):
        one, _ = graph.walk(x[:n], graph.linked(x[:n]), x[:3], 80)
        assert sorted(one[0].tolist()) == list(range(n))


def test_walks_only_where_they_look_at_fewer_vectors(monkeypatch):
    """A walk of the beam over a shard of SHARD looked at as many vectors as the shard holds, one by one."""
    walked = []
    real = graph.walk
    monkeypatch.setattr(graph, "walk", lambda x, links, q, beam: walked.append(len(x)) or real(x, links, q, beam))
    x = np.array([v for _, v in clustered(graph.SHARD)])
    row = {"ids": list(range(len(x))), "dead": [3, 5], "vectors": x.tobytes(), "links": graph.linked(x).tobytes()}
    live = np.array([i not in (3, 5) for i in range(len(x))])
    for i, ids, s in graph.shard_best(row, x[:50], 10, graph.BEAM, False):
        flat = np.where(live, x @ x[i], -np.inf)
        assert set(np.argsort(-flat)[:10]) <= set(ids.tolist()) and np.allclose(s, flat[ids])
    assert walked == []
    assert len(list(graph.shard_best(row, x[:50], 10, 40, False))) == 50 and walked == [len(x)]
