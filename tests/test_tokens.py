"""Words found in Arrow batches are those of the column expressions; a search stores no counts of other terms."""

import random

import pytest
from pyspark.sql import functions as F

from docsluice.functions import text as T
from docsluice.functions import tokens
from docsluice.operators import dense, lexical

ODD = ["", None, "a", "the of", "Él  cañón—no", "1,000,5 a,1 1,a ,1 1,", "a-b.c/d a--b -a b- $5.0% a_b.", "x\ny\r\tz", "ªµº²³¹¼½¾×÷ßÿÀÞ", "İstanbul ΣΑΣ 漢字 the", "ends,1", "2", ",", "é", "\x00a\x85b\xa0c", "٣,٤ ١٢"]


def texts():
    r = random.Random(5)
    signs = "aZ09_$%,.-/ \n\tÉéßµª²×÷½ÿ" * 3 + "€İσ"
    return ODD + ["".join(r.choice(signs[:-3] if i % 3 else signs) for _ in range(r.randint(0, 80))) for i in range(300)]


def listed(row, words, n):
    out = [[] for _ in range(n)]
    for i, w in zip(row.tolist(), words.to_pylist(), strict=True):
        out[i].append(w)
    return out


@pytest.mark.parametrize("piece", [1, 100, 1 << 24])
@pytest.mark.parametrize("found,column", [(tokens.terms, T.bm25_runs), (tokens.content, T.word_tokens)])
def test_words_are_those_of_the_columns(spark, monkeypatch, found, column, piece):
    monkeypatch.setattr(tokens, "TEXT_BYTES", piece)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string").coalesce(1)
    want = T.content_words(F.col("t")) if found is tokens.content else column(F.col("t"))
    rows = df.select("i", want.alias("want"), *tokens.columns(F.col("t"), column)).orderBy("i").toArrow()
    got = listed(*found(rows.column("text").combine_chunks(), rows.column("words").combine_chunks()), rows.num_rows)
    assert got == rows.column("want").to_pylist()
    assert 16 < rows.column("text").null_count < 200


def test_vectors_from_texts_are_those_from_words(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_WORDS", 50)
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts())], "k string, t string").coalesce(1)
    ids, a = dense._made(dense._texts(df, "k", "t").toArrow(), "k", 384)
    want, b = dense._made(dense._words(df, "k", "t").toArrow(), "k", 384)
    assert ids == want and a == pytest.approx(b)


def test_only_the_queries_terms_are_counted(spark, monkeypatch):
    """Before, all terms of all chunks were counted and stored, and read again to be scored."""
    labels, store = [], lexical.stored
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts() + ["radar power", "radar x of 1,000"])], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "radar power radar"), (2, "É 1000 a_b"), (3, ""), (4, "σ $5.0%")], "query_id bigint, query string")
    twice = chunks.unionByName(chunks.where("content = 'radar power'"))  # counted as before
    monkeypatch.setattr(lexical, "TERM_BLOCK", 2)
    monkeypatch.setattr(dense, "CHUNK_BLOCK", 40)
    monkeypatch.setattr(lexical, "stored", lambda df, label: labels.append(label) or store(df, label))
    got = lexical.scores(chunks, queries)
    assert "counted" not in labels
    counted = lexical._counted(chunks)[0]
    want = lexical.met(counted.where("terms <> ''").select("chunk_id", "dl", "terms", "tfs"), lexical.query_terms(queries).join(lexical._frequencies(counted), "term").crossJoin(lexical._statistics(counted)), 4, lexical._block_scores(lexical.K1, lexical.B, None), got.schema, True)
    rows = lambda df: {(r["query_id"], r["chunk_id"]): r["bm25"] for r in df.collect()}
    assert rows(got) == pytest.approx(rows(want)) and len(rows(got)) == 5
    assert len(rows(lexical.scores(twice, queries))) == len(rows(got)) and "counted" in labels
