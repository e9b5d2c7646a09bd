"""BM25 over chunk tables: statistics, scores, top-k for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import tokens
from ..functions.tables import parted, stored
from .dense import CLOSE, _blocks, _by_key, _unpack, met

K1, B = 1.5, 0.75
TOP = 20
TERM_BLOCK = 1 << 16
ENTRIES = 1 << 21  # products of a term's weight in a chunk and its weights in queries that are held at once


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each row with their counts, from ``bm25_runs``; the terms that ``bm25_tokens`` leaves out go once for each distinct one."""
    stop = pa.array(T.STOPWORDS)
    for b in batches:
        runs = pc.split_pattern(b.column(1), " ")
        coded = runs.flatten().dictionary_encode()
        names, term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
        meant = pc.and_(pc.greater_equal(pc.utf8_length(names), T.LEAST_TERM), pc.invert(pc.is_in(names, stop))).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(meant[term])
        row, term = row[held], term[held]
        cell, tf = np.unique(row * len(names) + term, return_counts=True)
        row_of, term_of = np.divmod(cell, max(1, len(names)))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row_of, minlength=b.num_rows)))), pa.int32())
        dl, times = pa.array(np.bincount(row, minlength=b.num_rows), pa.int32()), pa.array(np.ones(b.num_rows, np.int64))
        terms = pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(term_of))), " ")
        yield pa.RecordBatch.from_arrays([b.column(0), dl, times, terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["chunk_id", "dl", "times", "terms", "tfs"])


def counted(chunks: DataFrame) -> DataFrame:
    """``_counted`` without its second part."""
    return _counted(chunks)[0]


def _counted(chunks: DataFrame) -> tuple[DataFrame, bool]:
    """(chunk_id, dl, times, terms, tfs), stored: the distinct terms of each chunk, between blanks, with their counts.

    No term holds a blank, and one string a chunk moves faster than an array of
    them. A chunk is counted where it lies, without a shuffle. Only rows that share a
    chunk_id are grouped, those of the same dl as one row; times is how many they were.
    Besides, whether no two chunks share a chunk_id.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", F.array_join(T.bm25_runs(F.col("content")), " ").alias("runs"))
    rows = stored(rows.mapInArrow(_terms_of, f"chunk_id {kind}, dl int, times bigint, terms string, tfs array<int>"), "counted")
    once, more = parted(rows, "chunk_id")
    if more is None:
        return rows, True
    terms = _inline(more).groupBy("chunk_id", "dl", "term").agg(F.sum("tf").alias("tf")).groupBy("chunk_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    times = more.groupBy(F.col("chunk_id").alias("id_"), F.col("dl").alias("dl_")).agg(F.sum("times").alias("times"))
    whole = times.join(terms, F.col("chunk_id").eqNullSafe(F.col("id_")) & (F.col("dl") == F.col("dl_")), "left")
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    whole = whole.select(F.col("id_").alias("chunk_id"), F.col("dl_").alias("dl"), "times", F.coalesce("x", none).alias("x"))
    return stored(once.unionByName(whole.select("chunk_id", "dl", "times", F.array_join("x.term", " ").alias("terms"), F.col("x.tf").cast("array<int>").alias("tfs"))), "counted"), False


def _inline(rows: DataFrame) -> DataFrame:
    each = rows.where("terms <> ''").select("chunk_id", "dl", F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))))
    return each.select("chunk_id", "dl", "term", F.col("tf").cast("bigint").alias("tf"))


def term_frequencies(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(chunk_id, dl, term, tf). With ``only`` (column term) without other terms."""
    return _kept(_inline(counted(chunks)), only)


def _kept(tf: DataFrame, only: DataFrame | None) -> DataFrame:
    return tf if only is None else tf.join(only.select("term").distinct(), "term", "left_semi").select("chunk_id", "dl", "term", "tf")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pc.split_pattern(b.column(0), " ").flatten().value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "n"])


def _frequencies(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``document_frequencies`` from ``counted`` chunks, summed in each batch before terms become rows. With ``only`` (column term) without other terms."""
    each = rows.where("terms <> ''").select("terms").mapInArrow(_holders, "term string, n bigint")
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term").agg(F.sum("n").alias("df"))


def chunk_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df) of all terms."""
    return _frequencies(counted(chunks))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: n and avgdl; chunks without a term count."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(T.bm25_tokens(F.col("content")))), F.lit(0.0)).alias("avgdl"))


def _statistics(rows: DataFrame) -> DataFrame:
    """The same from ``counted`` chunks."""
    n = F.sum("times")
    return rows.agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("dl") * F.col("times")) / n, F.lit(0.0)).alias("avgdl"))


def inverse_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, idf) of all terms."""
    rows = counted(chunks)
    each = _frequencies(rows).crossJoin(F.broadcast(_statistics(rows)))  # one row
    return each.select("term", idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def weight(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated term counts as often as it stands."""
    return queries.select("query_id", F.explode(T.bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _gains(asked: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a block of queries, the queries, and where each term's part of the rest starts: its queries and what it weighs in them."""
    names = asked.column("term").combine_chunks().dictionary_encode()
    queries = asked.column("query_id").combine_chunks().dictionary_encode("encode")
    n, df, qtf = (asked.column(c).to_numpy().astype(float) for c in ("n", "df", "qtf"))
    term = names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(names.dictionary)))))
    return names.dictionary, queries.dictionary, starts, queries.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), (qtf * np.log((n - df + 0.5) / (df + 0.5) + 1))[order]


def _summed(at: np.ndarray, term: np.ndarray, part: np.ndarray, n: int, gains: tuple) -> np.ndarray:
    """Scores of n places as a row for each query: each entry (place, term, part) meets only the queries of its term."""
    _, queries, starts, query, gain = gains
    out = np.zeros(len(queries) * n)
    many = starts[term + 1] - starts[term]
    upto = np.cumsum(many)
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ENTRIES, "right")))
        m, first = many[lo:hi], starts[term[lo:hi]]
        each = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
        out += np.bincount(query[each] * n + np.repeat(at[lo:hi], m), gain[each] * np.repeat(part[lo:hi], m), len(out))
        lo = hi
    return out.reshape(len(queries), n)


def _best(s: np.ndarray, k: int | None) -> np.ndarray:
    """Which scores above 0 may be among the k best of their row."""
    if k is None or s.shape[1] <= k:
        return s > 0
    return (s > 0) & (s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - CLOSE)


def _held(texts: pa.Table, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """dl of each text; and of each of ``names`` in a text the text, the name and the count."""
    row, words = tokens.terms(texts.column("text").combine_chunks(), texts.column("words").combine_chunks())
    coded = words.dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    meant = pc.and_(pc.greater_equal(pc.utf8_length(coded.dictionary), T.LEAST_TERM), pc.invert(pc.is_in(coded.dictionary, pa.array(T.STOPWORDS)))).to_numpy(zero_copy_only=False)
    known = pc.fill_null(pc.index_in(coded.dictionary, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    dl = np.bincount(row[meant[of]], minlength=texts.num_rows)
    asked = np.flatnonzero(known[of] >= 0)
    cell, tf = np.unique(row[asked] * max(1, len(names)) + known[of[asked]], return_counts=True)
    return dl, *np.divmod(cell, max(1, len(names))), tf


def _asked_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each term of a block what the texts that a task has seen add up to: how many hold it, how many there are, their lengths."""
    seen = {}
    for x in batches:
        for texts, block in zip(*x.columns, strict=True):
            names = block.as_py()
            if names not in seen:
                terms = _unpack(block).column("term").combine_chunks()
                seen[names] = [terms, np.zeros(len(terms), np.int64), 0, 0]
            sums, dl_term = seen[names], _held(_unpack(texts), seen[names][0])
            sums[1] += np.bincount(dl_term[2], minlength=len(sums[0]))
            sums[2] += len(dl_term[0])
            sums[3] += int(dl_term[0].sum())
    for terms, df, n, length in seen.values():
        yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(np.full(len(terms), n)), pa.array(np.full(len(terms), length))], names=["term", "df", "n", "length"])


def _text_scores(k1: float, b: float, k: int | None):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """Scores of one block of texts for one block of queries."""
        gains = _gains(asked)
        dl, row, term, tf = _held(texts, gains[0])
        s = _summed(row, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / asked.column("avgdl")[0].as_py())), texts.num_rows, gains)
        q, c = np.nonzero(_best(s, k))
        return pa.table({"query_id": gains[1].take(pa.array(q)), "chunk_id": texts.column("chunk_id").combine_chunks().take(pa.array(c)), "bm25": pa.array(s[q, c])})

    return run


def _block_scores(k1: float, b: float, k: int | None):
    def run(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        """Scores of one block of chunks for one block of queries."""
        if not chunks.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], chunks.schema.field("chunk_id").type), "bm25": pa.array([], pa.float64())})
        gains = _gains(asked)
        ids = chunks.column("chunk_id").combine_chunks().dictionary_encode("encode")
        words = pc.split_pattern(chunks.column("terms").combine_chunks(), " ")
        row = np.repeat(np.arange(chunks.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(words.flatten(), gains[0]), -1).to_numpy(zero_copy_only=False)
        tf = chunks.column("tfs").combine_chunks().flatten().to_numpy()
        held = np.flatnonzero(term >= 0)
        row, term, tf = row[held], term[held], tf[held].astype(float)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * chunks.column("dl").to_numpy()[row] / asked.column("avgdl").to_numpy()[0]))
        s = _summed(ids.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64), term, part, len(ids.dictionary), gains)
        q, c = np.nonzero(_best(s, k))
        return pa.table({"query_id": gains[1].take(pa.array(q)), "chunk_id": ids.dictionary.take(pa.array(c)), "bm25": pa.array(s[q, c])})

    return run


def scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, k: int | None = None, single: bool = False) -> DataFrame:
    """(query_id, chunk_id, bm25) of every chunk with a term of the query; with ``k``, of those that may be among the query's k best.

    Chunks meet the queries in blocks (``dense.met``), so a chunk's score for all
    queries of a block is made in one place. Their texts are read twice, first for the
    frequencies of the queries' terms, and nothing is counted of other terms. Only where
    chunks share a chunk_id, which ``single`` rules out, are ``counted`` ones stored. Pass a stored table.
    """
    asked = stored(query_terms(queries), "asked")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, bm25 double"
    if not (single or alone(chunks)):
        rows, _ = _counted(chunks)
        weights = asked.join(stored(_frequencies(rows, asked), "df"), "term").crossJoin(F.broadcast(_statistics(rows)))  # one row
        return met(rows.where("terms <> ''").select("chunk_id", "dl", "terms", "tfs"), weights, queries.count(), _block_scores(k1, b, k), schema)
    texts = chunks.select("chunk_id", *tokens.columns(F.col("content"), T.bm25_runs))
    names = asked.select("term").distinct()
    blocks = stored(_by_key(names, "term", max(1, -(-names.count() // TERM_BLOCK)), "b"), "terms")
    each = texts.mapInArrow(_blocks, "a binary").crossJoin(blocks).select("a", "b").mapInArrow(_asked_figures, "term string, df bigint, n bigint, length bigint")
    df = stored(each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("length").alias("length")).where("df > 0"), "df")
    weights = asked.join(df.select("term", "df", "n", (F.col("length") / F.col("n")).alias("avgdl")), "term")
    return met(texts, weights, queries.count(), _text_scores(k1, b, k), schema, True)


def alone(chunks: DataFrame) -> bool:
    """Whether no two chunks share a chunk_id. The ids are read."""
    return parted(chunks.select("chunk_id"), "chunk_id")[1] is None


def search(chunks: DataFrame, queries: DataFrame, k: int = TOP, single: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of each query, as of ``top``. Each block gives its own best."""
    return top(scores(chunks, queries, k=k, single=single), k=k)


def top(scored: DataFrame, column: str = "bm25", k: int = TOP) -> DataFrame:
    """Ranks 1..k of each query by the score to six places, ties by chunk_id; scores of 0 or less are out."""
    s = F.round(column, 6)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.select("query_id", "chunk_id", s.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
