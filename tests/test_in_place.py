"""Steps that work on each row where it lies: no shuffle of words, and rows that share a key are still one."""

import math

import pytest
from pyspark.sql import functions as F

from docsluice.functions import text as T
from docsluice.operators import dense, lexical, retrieve

CHUNKS = [("c1", "radar power radar"), ("c1", "power of radar, power"), ("c2", "cooling fluid"), ("c3", ""), (None, "radar"), (None, "fluid fluid")]
QUERIES = [(1, "radar power radar"), (2, "the of"), (3, "fluid")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, content string"), spark.createDataFrame(QUERIES, "query_id bigint, query string")


def plain_vectors(dim):
    """Slot sums of each chunk_id by plain loops."""
    import hashlib

    out = {}
    for key, text in CHUNKS:
        words = [w for w in text.lower().replace(",", "").split() if w not in T.STOPWORDS]
        for i, w in enumerate(words):
            hits = [(hashlib.md5(w.encode()), 1 + 1 / (i + 1))] + ([(hashlib.sha1(f"{words[i - 1]}_{w}".encode()), 1.5)] if i else [])
            for h, x in hits:
                n = int(h.hexdigest(), 16)
                v = out.setdefault(key, {})
                v[n % dim] = v.get(n % dim, 0.0) + (x if n >> 8 & 1 else -x)
    return {k: {s: x / math.sqrt(sum(y * y for y in v.values())) for s, x in v.items()} for k, v in out.items()}


@pytest.mark.parametrize("dim", [384, 768])
def test_vectors_of_shared_keys(tables, dim):
    got = {r["chunk_id"]: dict(zip(r["slots"], r["weights"], strict=True)) for r in dense.embed(tables[0], "chunk_id", "content", dim).collect()}
    want = plain_vectors(dim)
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key] == pytest.approx(v)


def test_dense_search_of_shared_keys(tables):
    vectors, rows = plain_vectors(384), dense.search(*tables).collect()
    assert len(rows) == len(QUERIES) * len(vectors)
    asked = {r["query_id"]: dict(zip(r["slots"], r["weights"], strict=True)) for r in dense.embed(tables[1], "query_id", "query").collect()}
    for r in rows:
        assert r["score"] == pytest.approx(sum(x * asked[r["query_id"]].get(s, 0.0) for s, x in vectors[r["chunk_id"]].items()), abs=1e-6)


def test_bm25_of_shared_keys(tables):
    chunks, queries = tables
    tokens = [(k, [w for w in t.lower().replace(",", "").split() if w not in T.STOPWORDS]) for k, t in CHUNKS]
    tf = {}
    for key, words in tokens:
        for w in words:
            tf[key, len(words), w] = tf.get((key, len(words), w), 0) + 1
    assert {(r["chunk_id"], r["dl"], r["term"]): r["tf"] for r in lexical.term_frequencies(chunks).collect()} == tf
    df = {w: sum(x[2] == w for x in tf) for w in {x[2] for x in tf}}
    n, avgdl = len(CHUNKS), sum(len(w) for _, w in tokens) / len(CHUNKS)
    idf = {w: math.log((n - d + 0.5) / (d + 0.5) + 1) for w, d in df.items()}
    assert {r["term"]: r["idf"] for r in lexical.inverse_frequencies(chunks).collect()} == pytest.approx(idf)
    want = {}
    for q, text in QUERIES:
        for w in text.split():
            for (key, dl, term), n_ in tf.items():
                if w == term:
                    want[q, key] = want.get((q, key), 0.0) + idf[w] * n_ * 2.5 / (n_ + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert {(r["query_id"], r["chunk_id"]): r["bm25"] for r in lexical.scores(chunks, queries).collect()} == pytest.approx(want)
    best = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.search(chunks, queries, k=1).collect()}
    assert best == {x: pytest.approx(s, abs=1e-6) for x, s in want.items() if s == max(t for y, t in want.items() if y[0] == x[0])}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_no_shuffle_of_words(spark):
    """Before, every word and pair of words of a text was a row of a shuffle."""
    docs = spark.createDataFrame([(1, "radar power"), (2, "cooling")], "chunk_id bigint, content string")
    assert shuffles(dense.embed(docs, "chunk_id", "content")) == 0
    assert shuffles(lexical.term_frequencies(docs)) == 0


def test_retrieved_rows_are_read_back(spark):
    """Before, every step that read the retrieved chunks ranked and joined them again."""
    chunks = spark.createDataFrame([("c1", "t", "GENERAL", "radar power", 1, 1, 1), ("c2", "t", "GENERAL", "cooling", 1, 1, 1)], "chunk_id string, title string, category string, content string, page_number int, start_line int, end_line int")
    got = retrieve.hybrid(chunks, spark.createDataFrame([(1, "radar")], "query_id bigint, query string"))
    assert shuffles(got) == 0 and [r["chunk_id"] for r in got.orderBy("rank").collect()] == ["c1", "c2"]


def test_blank_is_what_strip_empties(spark):
    texts = ["", " ", "\n\t\x0b　 ", "a", "  a ", "​", "x\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.blank(F.col("t")).alias("b"), (T.strip(F.col("t")) == "").alias("s")).collect()
    assert [r["b"] for r in rows] == [r["s"] for r in rows]
