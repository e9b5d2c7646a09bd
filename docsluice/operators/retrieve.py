"""Rank fusion, hybrid retrieval, the sensitivity gate, context blocks and extractive answers for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.tables import stored
from . import collection, dense, lexical

RRF_K = 60
TOP_K = 4
SHOWN = ("chunk_id", "title", "category", "content", "page_number", "start_line", "end_line")  # what retrieval reads of a chunk
NO_FACTS = "The provided documents do not contain information regarding this query."
NO_DOCUMENTS = "No relevant documents found in the local knowledge base."
LEAD = "Based on verified local documentation ["
NOTE = "\n\nNote: Local LLM unavailable. Response synthesized deterministically from retrieved chunks only."


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, chunk_id, rank), in the order given.

    (query_id, chunk_id, rrf, rank): the sum of 1 / (k + rank), ranked as it is
    and then rounded to six places; ties go to the chunk seen first, ranking by ranking. A chunk that stands
    twice in one ranking counts twice.
    """
    both = None
    for i, r in enumerate(rankings):
        one = r.select("query_id", "chunk_id", (1.0 / (F.lit(k) + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("i"), F.col("rank").alias("r")).alias("seen"))
        both = one if both is None else both.unionByName(one)
    total = both.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("whole"), F.min("seen").alias("seen"))
    by = Window.partitionBy("query_id").orderBy(F.desc("whole"), "seen", "chunk_id")
    return total.withColumn("rank", F.row_number().over(by)).select("query_id", "chunk_id", F.round("whole", 6).alias("rrf"), "rank")


def citation(title: Column, page: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("Doc: "), title, F.lit(", Page "), page, F.lit(", Line "), first, F.lit("-"), last)


def rankings(chunks: DataFrame, queries: DataFrame, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """The rankings of stored chunks by vectors and by words, stored. Whether chunks share a chunk_id is looked up once."""
    single = lexical.alone(chunks)
    return stored(dense.search(chunks, queries, dim, single=single), "near"), stored(lexical.search(chunks, queries, single=single), "words")


def hybrid(chunks: DataFrame, queries: DataFrame, top_k: int = TOP_K, dim: int = 384, k: int = RRF_K) -> DataFrame:
    """The fused top_k chunks of each query with their scores (0 where a ranking lacks the chunk), text and citation.

    A column top_k of ``queries`` takes precedence over the argument. Chunks
    and both rankings are stored, as several steps read each.
    """
    chunks = stored(chunks.select(*SHOWN), "chunks")
    near, words = rankings(chunks, queries, dim)
    return joined(chunks, queries, near, words, top_k, k)


def joined(chunks: DataFrame, queries: DataFrame, near: DataFrame, words: DataFrame, top_k: int = TOP_K, k: int = RRF_K) -> DataFrame:
    """``hybrid`` from stored chunks and rankings. The few best of each query are stored before they meet the chunks, and again with their texts, so that the chunks are read once, however often the result is."""
    limits = queries.select("query_id", (F.col("top_k") if "top_k" in queries.columns else F.lit(top_k)).alias("limit"))
    best = fuse([near, words], k).join(limits, "query_id").where(F.col("rank") <= F.col("limit")).drop("limit")
    best = best.join(near.select("query_id", "chunk_id", F.col("score").alias("sim")), ["query_id", "chunk_id"], "left").join(words.select("query_id", "chunk_id", F.col("score").alias("bm")), ["query_id", "chunk_id"], "left")
    rows = stored(best, "best").join(chunks.select(*SHOWN), "chunk_id")
    rows = rows.select(
        "query_id", "rank", "chunk_id", "title", "category", "content", "page_number", "start_line", "end_line", F.round(F.coalesce("sim", F.lit(0.0)), 4).alias("similarity_score"),
        F.round(F.coalesce("bm", F.lit(0.0)), 4).alias("bm25_score"), F.round("rrf", 4).alias("rrf_score"), citation(F.col("title"), F.col("page_number"), F.col("start_line"), F.col("end_line")).alias("citation_label"),
    )
    return stored(rows, "retrieved")


def gate(queries: DataFrame, retrieved: DataFrame, mode: Column | None = None) -> DataFrame:
    """(query_id, n_chunks, blocked_category, status): a cloud query with a sensitive chunk is BLOCKED, one without chunks NO_CONTEXT, else OK. blocked_category is that of the best-ranked sensitive chunk."""
    mode = F.lit("cloud") if mode is None else mode
    sensitive = collection.is_sensitive(F.col("category"))
    seen = retrieved.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(sensitive, F.struct("rank", "category"))).alias("s"))
    rows = queries.withColumn("mode_", mode).join(seen, "query_id", "left")
    blocked = (F.col("mode_") == "cloud") & F.col("s").isNotNull()
    return rows.select("query_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.when(blocked, F.col("s.category")).alias("blocked_category"), F.when(blocked, "BLOCKED").when(F.col("n").isNull(), "NO_CONTEXT").otherwise("OK").alias("status"))


def request_errors(queries: DataFrame) -> DataFrame:
    """Add error_code: 400 for blank text or NUL, 422 for more than 4000 characters, a top_k outside 1..20 (if there is one) or null; else null."""
    q = F.col("query")
    code = F.when(q.isNull() | (F.length(q) > 4000), 422).when(F.contains(q, F.lit("\x00")) | (T.strip(q) == ""), 400)
    if "top_k" in queries.columns:
        code = F.when(~F.col("top_k").between(1, 20), 422).otherwise(code)
    return queries.withColumn("error_code", code)


def context(retrieved: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources in the order of rank. A query has at most 20 of them."""
    block = F.concat(F.lit("--- SOURCE "), F.col("rank"), F.lit(" ["), F.col("citation_label"), F.lit("] ---\n"), F.col("content"), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n").alias("context"))


def prompt(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Context Blocks:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion:\n"), F.col("query"))
    return queries.join(contexts, "query_id", "left").select("query_id", text.alias("prompt"))


def best_sentences(text: Column, query: Column, most: int = 2) -> Column:
    """The sentences that share most words with the query, ties by place."""
    pieces = F.filter(F.transform(T.sentences(text, ".!?\n"), T.strip), lambda s: s != "")
    rated = T.let(F.array_distinct(T.word_tokens(query)), lambda asked: F.transform(pieces, lambda s, i: F.struct((-F.size(F.array_intersect(T.word_tokens(s), asked))).alias("k"), i.alias("i"), s.alias("s"))))
    return F.transform(F.slice(F.array_sort(rated), 1, most), lambda x: x["s"])


def answers(queries: DataFrame, retrieved: DataFrame, best: int = 3) -> DataFrame:
    """(query_id, answer): quotes of the best chunks between their citations, or the refusal."""
    by = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "rank")
    rows = retrieved.withColumn("r", F.row_number().over(by)).where(F.col("r") <= best).join(queries.select("query_id", "query"), "query_id")
    found = best_sentences(F.col("content"), F.col("query"))
    quoted = F.array_join(F.transform(F.col("found"), lambda s: F.concat(F.lit('"'), s, F.lit('"'))), " ")
    rows = rows.withColumn("found", found).where(F.size("found") > 0)
    section = F.concat(F.lit(LEAD), F.col("citation_label"), F.lit("]:\n"), quoted, F.lit(" ["), F.col("citation_label"), F.lit("]"))
    made = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
    return queries.join(made, "query_id", "left").select("query_id", F.coalesce(F.concat(F.col("body"), F.lit(NOTE)), F.lit(NO_FACTS)).alias("answer"))


def events(answered: DataFrame) -> DataFrame:
    """One row for each transport event of an answer: metadata, a token for each word, complete."""
    words = answered.select("query_id", F.posexplode(F.split("answer", " ")).alias("i", "w"))
    token = words.select("query_id", (F.col("i") + 1).alias("seq"), F.lit("token").alias("event"), F.concat(F.col("w"), F.lit(" ")).alias("data"))
    meta = answered.select("query_id", F.lit(0).alias("seq"), F.lit("metadata").alias("event"), F.lit("").alias("data"))
    done = answered.select("query_id", (F.size(F.split("answer", " ")) + 1).alias("seq"), F.lit("complete").alias("event"), F.col("answer").alias("data"))
    return meta.unionByName(token).unionByName(done)
