"""Steps that the retrieval queries share are done once, and on what is read alone."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsluice.functions import text as T
from docsluice.operators import chunk, dense, lexical, retrieve
from docsluice.plans import registry


def test_line_ends_are_replaced_only_where_there_are_some(spark):
    """Before, every text was searched for three replacements, byte by byte, and each window for all its line feeds."""
    texts = ["", None, "a", "a\r\nb\rc\nd\x00e", "\r", "\x00", "\r\r\n\n", "é\r\n漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normal_lines(F.col("t")).alias("n"))
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n"] for r in df.collect()] == [t and t.replace("\x00", " ").replace("\r\n", "\n").replace("\r", "\n") for t in texts]


@pytest.mark.parametrize("size,overlap", [(450, 60), (5, 3), (4, 0), (7, 6)])
def test_last_lines_of_windows(spark, size, overlap):
    texts = ["a\nb\n\nc\n" * 30, "\n\n\nx\n\n", "é\n漢\n" * 9, "no line ends"]
    docs = spark.createDataFrame([(f"d{i}", "t", "LEGAL", t) for i, t in enumerate(texts)], "doc_key string, title string, category string, text string")
    rows = chunk.fixed(docs, size, overlap).collect()
    for r in rows:
        t = texts[int(r["doc_key"][1:])]
        at = r["chunk_index"] * (size - overlap)
        assert (r["content"], r["start_line"]) == (t[at : at + size], t[:at].count("\n") + 1)
        assert r["end_line"] == r["start_line"] + r["content"].count("\n")
    assert len(rows) > 3


CHUNKS = "chunk_id string, title string, category string, content string, page_number int, start_line int, end_line int"


@pytest.mark.parametrize("twice", [False, True])
def test_shared_ids_are_looked_up_once(spark, monkeypatch, twice):
    """Before, both rankings read and shuffled all ids to find shared ones."""
    calls = []
    for module in (dense, lexical):
        monkeypatch.setattr(module, "parted", lambda rows, key, f=module.parted: calls.append(key) or f(rows, key))
    rows = [(f"c{i}", "t", "LEGAL", f"radar power {i}", 1, 1, 1) for i in range(5)]
    chunks = spark.createDataFrame(rows + rows[:1] * twice, CHUNKS)
    got = retrieve.gate(q := spark.createDataFrame([(1, "radar 3"), (2, "nothing")], "query_id bigint, query string"), retrieve.hybrid(chunks, q, top_k=2)).collect()
    assert {r["query_id"]: r["status"] for r in got} == {1: "BLOCKED", 2: "BLOCKED"}
    assert twice or calls == ["chunk_id"]


def test_an_entry_meets_only_the_queries_of_its_term(monkeypatch):
    """Before, each entry of a chunk was multiplied with all queries of a block."""
    asked = pa.table({"query_id": [7, 7, 8, 9], "term": ["a", "b", "b", "c"], "qtf": [1, 2, 1, 1], "n": [9] * 4, "df": [3, 4, 4, 1], "avgdl": [2.0] * 4})
    gains = lexical._gains(asked)
    names, queries = gains[0].to_pylist(), gains[1].to_pylist()
    rng = np.random.default_rng(1)
    at, term, part = rng.integers(0, 6, 40), rng.integers(0, 3, 40), rng.random(40)
    want = np.zeros((3, 6))
    for r in asked.to_pylist():
        w = r["qtf"] * np.log((r["n"] - r["df"] + 0.5) / (r["df"] + 0.5) + 1)
        for p, t, x in zip(at, term, part, strict=True):
            want[queries.index(r["query_id"]), p] += w * x * (names[t] == r["term"])
    sizes, count = [], np.bincount
    monkeypatch.setattr(lexical.np, "bincount", lambda x, *a, **k: sizes.append(len(x)) or count(x, *a, **k))
    for entries in (1, 7, 1 << 21):
        monkeypatch.setattr(lexical, "ENTRIES", entries)
        sizes.clear()
        assert lexical._summed(at, term, part, 6, gains) == pytest.approx(want)
        assert sum(sizes) == sum(2 if names[t] == "b" else 1 for t in term)
    assert lexical._best(np.array([[3.0, 1, 0, 2, 2]]), 2).tolist() == [[True, False, False, True, True]]


def test_accuracy_stores_only_what_is_read(spark, monkeypatch, tmp_path):
    """Before, hashes, keys and word counts of all chunks were made and stored too."""
    spark.createDataFrame([(i, "src", f"radar power {i}") for i in range(4)], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "radar 2")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, store = {}, registry.stored
    monkeypatch.setattr(registry, "stored", lambda df, label: seen.setdefault(label, df.columns) and store(df, label))
    assert registry.QUERIES["doc_match_accuracy"](spark, str(tmp_path)).count() == 1
    assert sorted(seen["chunks"]) == sorted(retrieve.SHOWN)
