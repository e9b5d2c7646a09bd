"""The document collection: ingest with checks and dedup, categories, delete, manifest, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import stored

CATEGORIES = ("CLINICAL", "FINANCIAL", "LEGAL", "DEFENSE", "GENERAL")
SENSITIVE = CATEGORIES[:4]
MAX_CHARS = 5_000_000
MAX_CHUNKS = 10_000


def category_of(c: Column) -> Column:
    return F.when(c.isin(*CATEGORIES), c).otherwise(F.lit("GENERAL"))


def is_sensitive(c: Column) -> Column:
    return c.isin(*SENSITIVE)


def from_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents as raw input: row id, title, raw text, category."""
    return documents.select(
        F.col("doc_id").alias("row_id"), F.concat(F.col("source"), F.lit("_"), F.col("doc_id")).alias("title"), F.col("text").alias("raw"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("doc_id") % 5 + 1).cast("int")).alias("category"),
    )


def validated(raw: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Add text (normal line ends), sha256 of the raw text and load_error (null if fine). Nothing raises inside a job."""
    text = T.normal_lines(F.coalesce(F.col("raw"), F.lit("")))
    out = raw.withColumn("text", text).withColumn("sha256", T.sha256(F.coalesce(F.col("raw"), F.lit(""))))
    error = F.when(F.length(F.coalesce("raw", F.lit(""))) == 0, "EMPTY").when(T.blank(F.col("text")), "WHITESPACE").when(F.length("text") > max_chars, "TOO_LARGE")
    return out.withColumn("load_error", error).withColumn("category", category_of(F.col("category")))


def ingest(raw: DataFrame, existing: DataFrame | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """New documents: valid ones, one for each sha256 (smallest row_id), none that ``existing`` (column sha256) holds.

    Hashes and ids are stored first, and what they show to be copies, by itself,
    leaves the texts: these are shuffled only if the copies are too many to be
    broadcast. A group of copies costs each task one row.
    """
    fine = validated(raw, max_chars).where("load_error is null")
    ids = stored(fine.select("sha256", "row_id"), "ids")
    first = ids.groupBy("sha256").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256", "first")
    mark = F.xxhash64("sha256").alias("mark")  # short, as it only tells apart texts of one row_id
    copies = stored(ids.join(first, "sha256").where("row_id > first").select("row_id", mark).distinct(), "copies")
    out = fine.where("row_id is not null").join(copies, (fine["row_id"] == copies["row_id"]) & (F.xxhash64(fine["sha256"]) == copies["mark"]), "left_anti")
    if existing is not None:
        out = out.join(existing.select("sha256").distinct(), "sha256", "left_anti")
    return out.select(T.document_key(F.col("sha256")).alias("doc_key"), "row_id", "title", "category", "sha256", "text")


def corpus(spark, sf_dir: str) -> DataFrame:
    return ingest(from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def delete_documents(docs: DataFrame, chunks: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks without ``keys`` (column doc_key), and the number of chunks that went with each key."""
    gone = keys.select("doc_key").distinct()
    counts = docs.select("doc_key").join(gone, "doc_key", "left_semi").join(chunks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")), "doc_key", "left").select("doc_key", F.coalesce("n", F.lit(0)).alias("deleted_chunks"))
    return docs.join(gone, "doc_key", "left_anti"), chunks.join(gone, "doc_key", "left_anti"), counts


def reclassify(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """New categories from ``changes`` (doc_key, new_category); unknown ones become GENERAL. Chunks read their category from the documents."""
    new = changes.select("doc_key", category_of(F.col("new_category")).alias("new_category")).groupBy("doc_key").agg(F.max("new_category").alias("new_category"))
    return docs.join(new, "doc_key", "left").withColumn("category", F.coalesce("new_category", "category")).drop("new_category")


def manifest(chunks: DataFrame, n_documents: int | None = None) -> DataFrame:
    """One row: schema version, counts, and sha256 over the sorted chunk ids.

    Ids are hashed in groups by their first eight characters (65,536 groups, as
    keys are hex digits) and the groups' hashes in order, so no task holds all ids.
    """
    part = chunks.groupBy(F.substring("chunk_id", 1, 8).alias("p")).agg(F.count(F.lit(1)).alias("n"), T.sha256(F.array_join(F.array_sort(F.collect_list("chunk_id")), "")).alias("h"))
    docs = chunks.agg(F.count_distinct("doc_key").alias("document_count"))
    whole = part.agg(F.sum("n").alias("chunk_count"), T.sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")).alias("ids_sha256"))
    return whole.crossJoin(docs).select(F.lit("2.0").alias("schema_version"), "document_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "ids_sha256")


def manifest_holds(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether counts and hash equal the stored manifest's. Nothing is wiped."""
    now = manifest(chunks).select(*[F.col(c).alias("now_" + c) for c in ("document_count", "chunk_count", "ids_sha256")])
    return stored.crossJoin(now).select((F.col("document_count") == F.col("now_document_count")).alias("documents_ok"), (F.col("chunk_count") == F.col("now_chunk_count")).alias("chunks_ok"), (F.col("ids_sha256") == F.col("now_ids_sha256")).alias("ids_ok"))


def over_limit(chunks: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    """Documents that were cut into more than ``most`` chunks."""
    return chunks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def ingest_report(raw: DataFrame, cut, existing: DataFrame | None = None, most: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks that are taken in, and for every raw row (row_id, title, status, chunk_count).

    ``cut`` makes chunks of documents. Statuses: INGESTED; DUPLICATE of a row or
    of ``existing``, with 0 chunks; TOO_MANY_CHUNKS, which refuses the document;
    or the load error.
    """
    fresh = ingest(raw, existing, max_chars)
    chunks = cut(fresh)
    counts = chunks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"))
    refused = over_limit(chunks, most).select("doc_key")
    seen = fresh.join(counts, "doc_key", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n"))
    rows = validated(raw, max_chars).select("row_id", "title", "load_error").join(seen, "row_id", "left")
    status = F.coalesce("load_error", F.when(F.col("n").isNull(), "DUPLICATE").when(F.col("n") > most, "TOO_MANY_CHUNKS").otherwise("INGESTED"))
    report = rows.select("row_id", "title", status.alias("status"), F.when(status == "INGESTED", F.col("n")).otherwise(F.lit(0)).alias("chunk_count"))
    return fresh.join(refused, "doc_key", "left_anti"), chunks.join(refused, "doc_key", "left_anti"), report


def cleared(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The empty collection, and how many documents and chunks went."""
    counts = docs.agg(F.count(F.lit(1)).alias("deleted_documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("deleted_chunks")))
    return docs.limit(0), chunks.limit(0), counts


def matching(docs: DataFrame, needle: str) -> DataFrame:
    """Documents whose title or category holds ``needle`` in any case."""
    low = F.lit(needle.lower())
    return docs.where(F.contains(F.lower("title"), low) | F.contains(F.lower("category"), low))
