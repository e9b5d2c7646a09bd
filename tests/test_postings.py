"""The stored index against scores computed anew, through adds, replacements, removals, reruns and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from docsluice.operators import lexical, postings

TOPICS = [[f"{t}{i}" for i in range(30)] for t in ("river", "stone", "cloud", "metal", "paper")]


def chunks(seed, ids, topic=None):
    r = random.Random(seed)
    rows = []
    for i in ids:
        words = TOPICS[(topic if topic is not None else i // 40) % len(TOPICS)]
        rows.append((f"c{i:04d}", " ".join(r.choice(words) if r.random() < 0.8 else r.choice(["common", "shared", "usual"]) for _ in range(r.randint(0, 60)))))
    return rows


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 16)
    monkeypatch.setattr(postings, "BUCKETS", 3)
    return postings.PostingsIndex(spark, str(tmp_path / "index"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string").coalesce(2)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))


def test_index_equals_scores_anew(spark, index):
    queries = spark.createDataFrame([(1, "river1 river2 common"), (2, "stone3 stone3 shared"), (3, "nothing known"), (4, ""), (5, None), (6, "usual"), (7, "metal7 cloud5 paper9 river4")], "query_id int, query string")
    held = {}

    def check(k=5):
        want = rows_of(lexical.top(lexical.scores(frame(spark, sorted(held.items())), queries), k=k)) if held else []
        got, report = index.searched(queries, k)
        assert rows_of(got) == want
        return {r["query_id"]: (r["blocks"], r["blocks_read"]) for r in report.collect()}

    assert rows_of(index.search(queries)) == [] and index.statistics().first()["n"] == 0
    one = chunks(1, range(200))
    index.add(frame(spark, one), "a")
    held |= dict(one)
    reads = check()
    assert all(r <= n for n, r in reads.values()) and sum(r for _, r in reads.values()) < 0.8 * sum(n for n, _ in reads.values())
    two = chunks(2, range(190, 260), topic=2)  # replaces ten
    index.add(frame(spark, two), "b")
    index.add(frame(spark, two), "b")  # a batch that runs again
    held |= dict(two)
    check()
    gone = [f"c{i:04d}" for i in range(0, 230, 3)] + ["unknown"]
    index.remove(spark.createDataFrame([(i,) for i in gone], "chunk_id string"), "x")
    index.remove(spark.createDataFrame([(i,) for i in gone], "chunk_id string"), "x")
    held = {i: t for i, t in held.items() if i not in gone}
    check()
    n = index.statistics().first()
    anew = lexical.corpus_statistics(frame(spark, sorted(held.items()))).first()
    assert (n["n"], pytest.approx(n["avgdl"])) == (anew["n"], anew["avgdl"])
    index = index.compacted(index.path + "-new")
    assert {r["chunk_id"] for r in index.live().collect()} == set(held) and index.dead().count() == 0
    check(k=300)


def test_readding_a_removed_chunk_and_removing_all(spark, index):
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    index.add(frame(spark, [("x", "alpha beta"), ("y", "alpha")]), "a")
    index.remove(spark.createDataFrame([("x",), ("y",)], "chunk_id string"), "r")
    assert rows_of(index.search(queries)) == [] and index.statistics().first()["avgdl"] == 0
    index.add(frame(spark, [("x", "beta beta"), ("z", None)]), "b")
    assert [r[2] for r in rows_of(index.search(queries))] == ["x"] and index.statistics().first()["n"] == 2


def test_counts_of_sorted_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["z"],)], "t array<string>").select("t", postings._counts(F.col("t")).alias("c"))
    assert {tuple(r["t"]): {x["term"]: x["tf"] for x in r["c"]} for r in df.collect()} == {("b", "a", "b", "b"): {"a": 1, "b": 3}, (): {}, ("z",): {"z": 1}}


def test_terms_are_dealt_as_arrays(spark, index, monkeypatch):
    """Before, every term of every chunk was a row of a shuffle, and the tokens were stored once more."""
    plans = []
    write = postings.PostingsIndex._write
    monkeypatch.setattr(postings.PostingsIndex, "_write", lambda self, df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, *a))[1])
    monkeypatch.setattr(postings, "stored", None)
    index.add(frame(spark, [("x", "radar power"), ("y", "power")]), "dealt")
    plan = next(p for p in plans if "max_tf" in p).split("Exchange hashpartitioning")
    assert len(plan) == 3 and "Generate" not in plan[-1]


def test_a_query_takes_no_row_for_each_chunk(spark, index, monkeypatch):
    """Before, every chunk with a term of a query was a row of a shuffle for that query."""
    kept = {}
    store = postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, label: kept.setdefault(len(kept) if label in kept else label, store(df, label)))
    monkeypatch.setattr(postings, "PART", 2)
    monkeypatch.setattr(postings, "QUERY_BLOCK", 2)
    rows = [(f"c{i:03d}", "usual word " * (1 + i % 7)) for i in range(160)]
    index.add(frame(spark, rows), "a")
    best = [f"c{i:03d}" for i in range(6, 160, 7)][:5]
    index.remove(spark.createDataFrame([(i,) for i in best], "chunk_id string"), "r")
    queries = spark.createDataFrame([(i, "usual word") for i in range(5)], "query_id bigint, query string")
    got = index.search(queries, k=3)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert kept["early"].count() < 5 * 4 * 16  # four ranges of a query, 16 chunks in each, all with its terms
    live = frame(spark, [r for r in rows if r[0] not in best])
    assert rows_of(got) == rows_of(lexical.top(lexical.scores(live, queries), k=3))


def test_ranges_travel_packed(spark):
    """Before, every block of postings was a row of a shuffle; numbers go in as few bytes as hold them."""
    import pyarrow as pa

    rows = pa.table({"rng": [5, 5], "doc": pa.array([0, 1], pa.int32()), "dl": pa.array([3, 70000], pa.int32()), "terms": ["b a", "a c"], "tfs": pa.array([[1, 2], [300, 1]], pa.list_(pa.int32()))})
    packed = postings._inverted(2)(rows)
    assert packed.num_rows <= 2 and sum(len(x) for x in packed.column("docs").to_pylist()) == 4
    got = [r for b in postings._unpacked(packed.to_batches()) for r in b.to_pylist()]
    assert {r["term"]: (r["rng"], r["n"], r["max_tf"], r["min_dl"], r["docs"], r["tfs"], r["dls"]) for r in got} == {"a": (5, 2, 300, 3, [0, 1], [2, 300], [3, 70000]), "b": (5, 1, 1, 3, [0], [1], [3]), "c": (5, 1, 1, 70000, [1], [1], [70000])}
    buckets = {r["t"]: r["b"] for r in spark.createDataFrame([("a",), ("b",), ("c",)], "t string").select("t", F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(2)).alias("b")).collect()}
    assert {r["term"]: r["bucket"] for r in got} == buckets
