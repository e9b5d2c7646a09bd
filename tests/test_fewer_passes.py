"""Steps that all retrieval queries share: texts stay where they lie, and only what is read is stored."""

import pyarrow as pa
import pytest

from docsluice.functions import tables
from docsluice.functions import text as T
from docsluice.operators import collection, dense, lexical, retrieve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequencies_without_a_row_for_each_term(spark):
    """Before, every term of every chunk was a row before anything was counted."""
    texts = [("a", "radar power radar"), ("b", "Radar $1,000 x the"), ("b", "radar 1,a"), ("c", ""), ("c", "of x"), ("d", None)]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string")
    got = lexical.chunk_frequencies(chunks)
    assert "Generate" not in plan(got)
    assert {r["term"]: r["df"] for r in got.collect()} == {"radar": 3, "power": 1, "$1000": 1}
    tokens = chunks.select(T.bm25_tokens(chunks["content"]).alias("t")).collect()
    assert sorted(r["dl"] for r in lexical.counted(chunks.where("chunk_id <> 'c'")).collect()) == sorted([0] + [len(r["t"]) for r in tokens if r["t"]])


def test_ingest_leaves_texts_where_they_lie(spark):
    """Before, all texts were shuffled to find copies among them."""
    rows = [(1, "t", "one", "LEGAL"), (2, "t", "two", "LEGAL"), (3, "t", "one", "LEGAL"), (4, "t", "one", "LEGAL"), (2, "t", "two", "LEGAL"), (2, "t", "one", "LEGAL"), (None, "t", "two", "LEGAL"), (None, "t", "three", "LEGAL"), (5, "t", "", "LEGAL")]
    got = collection.ingest(spark.createDataFrame(rows, "row_id bigint, title string, raw string, category string"))
    assert "Exchange hashpartitioning" not in plan(got)
    assert sorted((r["row_id"], r["text"]) for r in got.collect()) == [(1, "one"), (2, "two"), (2, "two")]


def test_only_what_is_read_is_stored(spark, monkeypatch):
    """Before, hashes and word counts of all chunks were made and stored too."""
    seen, store = {}, retrieve.stored
    monkeypatch.setattr(retrieve, "stored", lambda df, label: seen.setdefault(label, df.columns) and store(df, label))
    chunks = spark.createDataFrame([("c1", "t", "GENERAL", "radar", 1, 1, 1, 1, "ff")], "chunk_id string, title string, category string, content string, page_number int, start_line int, end_line int, word_count int, sha256 string")
    assert retrieve.hybrid(chunks, spark.createDataFrame([(1, "radar")], "query_id bigint, query string")).count() == 1
    assert "content" in seen["chunks"] and not {"word_count", "sha256"} & set(seen["chunks"])


def test_a_block_hashes_a_word_once(monkeypatch):
    """Before, each 1024 texts of a block hashed their words anew."""
    names, make = [], dense._hashed
    monkeypatch.setattr(dense, "_hashed", lambda how, of, *rest: names.extend(of) or make(how, of, *rest))
    n = 3000
    ids, v = dense._made(pa.table({"chunk_id": [f"c{i}" for i in range(n)], "words": ["radar power radar"] * n}), "chunk_id", 384)
    assert len(ids) == n and sorted(names) == [b"power", b"power_radar", b"radar", b"radar_power"]
    assert (v * v).sum(axis=1) == pytest.approx(1) and (v == v[0]).all()


def test_chunks_meet_queries_where_they_lie(spark, monkeypatch):
    """Before, the words and the counted terms of all chunks were shuffled to blocks by their ids."""
    monkeypatch.setattr(dense, "CHUNK_BLOCK", 2)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 1)
    monkeypatch.setattr(dense, "PIECE", 1)
    chunks = spark.createDataFrame([(f"c{i:02}", "radar power " * (i + 1) + f"x{i}y") for i in range(9)], "chunk_id string, content string")
    queries = spark.createDataFrame([(i, f"radar x{i}y") for i in range(5)], "query_id bigint, query string")
    found = dense.met(dense._words(chunks, "chunk_id", "content"), dense._words(queries, "query_id", "query"), 5, dense._block_top(dense._made, 384, 20), dense.FOUND)
    assert "Exchange hashpartitioning" not in plan(found) and "Exchange hashpartitioning" not in plan(lexical.scores(chunks, queries))
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == [(q, f"c{i:02}") for q in range(5) for i in range(9)]
    best = lexical.search(chunks, queries, 1).collect()
    assert {r["query_id"]: r["chunk_id"] for r in best} == {i: f"c{i:02}" for i in range(5)}
    twice = dense.search(chunks.unionByName(chunks), queries, k=9).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in twice) == sorted((r["query_id"], r["chunk_id"], r["score"]) for r in dense.search(chunks, queries, k=9).collect())


def test_stored_files_are_read_by_more_tasks(spark, monkeypatch):
    """Before, one task read again all that one task had written."""
    monkeypatch.setattr(tables, "FILE_ROWS", 10)
    got = tables.stored(spark.range(0, 35, 1, 1), "few")
    assert got.count() == 35 and len(got.inputFiles()) == 4
