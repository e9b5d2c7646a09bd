"""Registered queries of the engine's own operators. Each reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..functions.tables import shared_dir, stored
from ..operators import chunk, collection, dense, graph, grounding, ledger, lexical, merkle, metrics, postings, privacy, retrieve, telemetry
from ..sources import files
from ..streaming import streams

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _kept_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """For queries that read the chunks more than once: those columns, or all."""
    return stored(_chunks(spark, d).select(*columns or "*"), "chunks")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed(collection.corpus(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))


def _probe(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each label as a query vector."""
    first = _t(spark, d, "embeddings").groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("x"))
    return first.select(F.col("label").cast("bigint").alias("query_id"), V.doubles(F.col("x.embedding")).alias("v"))


def _with_mean(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the first one of its label."""
    rows = _t(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("query_id"), V.doubles(F.col("embedding")).alias("a"))
    return rows.join(_probe(spark, d).withColumnRenamed("v", "b"), "query_id")


# ---- text scalars


@query
def tokenize_bm25(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.bm25_tokens(F.col("text")), " ").alias("tokens"))


@query
def word_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.word_tokens(F.col("text")), " ").alias("words"))


@query
def stopword_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.content_words(F.col("text")), " ").alias("words"))


@query
def sentence_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


@query
def normalize_ws(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.strip(T.squeeze(F.col("text"))).alias("plain"))


@query
def word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def sha256_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"))


@query
def doc_id_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.document_key(T.sha256(F.col("text"))).alias("doc_key"))


@query
def line_numbers(spark, d):
    """Place, line and page of every full stop of every text, from the pieces between them."""
    pieces = F.transform(F.split("text", "[.]"), lambda p: F.struct(F.length(p).alias("n"), T.newlines(p).alias("lines")))
    rows = _t(spark, d, "documents").select("doc_id", F.monotonically_increasing_id().alias("row"), pieces.alias("pieces"))
    rows = rows.select("doc_id", "row", F.size("pieces").alias("of"), F.posexplode("pieces").alias("i", "p")).where(F.col("i") < F.col("of") - 1)
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("doc_id", (F.sum("p.n").over(upto) + F.col("i")).cast("int").alias("at"), (F.sum("p.lines").over(upto) + 1).cast("int").alias("line"))
    return rows.select("doc_id", "at", "line", T.page_of(F.col("line")).alias("page"))


@query
def mask_secrets(spark, d):
    return _t(spark, d, "customer").select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))


@query
def file_extension(spark, d):
    """Extension and safe name of every page's URL path."""
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    return _t(spark, d, "pages").select("page_id", T.extension(path).alias("extension"), files.safe_name(path).alias("name"))


# ---- lexical


@query
def term_freq(spark, d):
    return lexical.term_frequencies(_chunks(spark, d)).select("chunk_id", "term", "tf")


@query
def doc_freq(spark, d):
    return lexical.chunk_frequencies(_chunks(spark, d))


@query
def corpus_stats(spark, d):
    return lexical.corpus_statistics(_chunks(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def idf(spark, d):
    return lexical.inverse_frequencies(_chunks(spark, d)).select("term", F.round("idf", 6).alias("idf"))


@query
def bm25_score_pair(spark, d):
    return lexical.scores(_chunks(spark, d), _questions(spark, d)).select("query_id", "chunk_id", F.round("bm25", 4).alias("bm25"))


@query
def bm25_topk(spark, d):
    return lexical.search(_chunks(spark, d), _questions(spark, d))


def _index(spark, d):
    """The chunks as a stored index: two adds, the second with the first chunk of every document once more, then the chunks of category LEGAL removed."""
    c = stored(_chunks(spark, d).select("chunk_id", "chunk_index", "category", "content"), "chunks")
    index = postings.PostingsIndex(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")
    index.add(c.where("chunk_index % 3 < 2"), "one")
    index.add(c.where("chunk_index = 0 or chunk_index % 3 = 2"), "two")
    index.remove(c.where("category = 'LEGAL'"), "legal")
    return index


@query
def bm25_index_topk(spark, d):
    """Top-k from stored postings after two adds and a removal."""
    return _index(spark, d).search(_questions(spark, d))


@query
def bm25_index_reads(spark, d):
    """How many postings blocks of a query's terms the search reads."""
    return _index(spark, d).searched(_questions(spark, d))[1]


# ---- vectors


@query
def dot_product(spark, d):
    return _with_mean(spark, d).select("vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query
def l2_norm(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query
def normalize_vec(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(V.normalised(F.col("v"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query
def cosine_similarity(spark, d):
    return _with_mean(spark, d).select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query
def cosine_distance(spark, d):
    return _with_mean(spark, d).select("vec_id", F.round(V.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query
def angular_degrees(spark, d):
    return _with_mean(spark, d).select("vec_id", F.round(V.angle(F.col("a"), F.col("b")), 3).alias("degrees"))


@query
def vector_validate(spark, d):
    return _vectors(spark, d).select("vec_id", V.flawed(F.col("v")).alias("flawed"), F.size("v").alias("dim"))


@query
def vector_topk(spark, d):
    return dense.vector_top(_vectors(spark, d), _probe(spark, d))


@query
def vector_index_topk(spark, d):
    """Top-k from stored small-world graphs after two adds and a removal, with the recall against the flat search of the same vectors. Queries are the vectors whose id is divisible by 20."""
    v = _vectors(spark, d)
    index = graph.VectorIndex(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    index.add(v.where("vec_id % 3 < 2"), "one")
    index.add(v.where("vec_id % 3 >= 1"), "two")
    index.remove(v.where("vec_id % 10 = 3"), "gone")
    queries = stored(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), "queries")
    found = stored(index.search(queries), "found")
    return found.crossJoin(F.broadcast(index.recall(found, queries)))  # one row


# ---- hash embeddings


def _slots(spark, d, dim):
    words = _t(spark, d, "documents").select(F.explode(T.content_words(F.col("text"))).alias("word")).distinct()
    m = F.md5("word")
    return words.select("word", V.hex_slot(m, 32, dim).alias("slot"), V.hex_sign(m, 32).alias("sign"))


@query
def hash_slots_384(spark, d):
    return _slots(spark, d, 384)


@query
def hash_slots_768(spark, d):
    return _slots(spark, d, 768)


def _sparse(spark, d, dim):
    e = dense.embed(_t(spark, d, "documents"), "doc_id", "text", dim)
    return e.select("doc_id", F.explode(F.arrays_zip("slots", "weights")).alias("x")).select("doc_id", F.col("x.slots").alias("slot"), (F.round("x.weights", 6) + 0.0).alias("weight"))


@query
def hash_embed_sparse(spark, d):
    return _sparse(spark, d, 384)


@query
def hash_embed_sparse_768(spark, d):
    return _sparse(spark, d, 768)


@query
def dense_topk(spark, d):
    return dense.search(_kept_chunks(spark, d, "chunk_id", "content"), _questions(spark, d))


@query
def cloud_topk(spark, d):
    """Search in the space of 768 dimensions, which only cloud mode may read."""
    return dense.search_space(_kept_chunks(spark, d, "chunk_id", "content"), _questions(spark, d), "cloud", "cloud")


@query
def both_spaces(spark, d):
    """What every chunk has in each space: slots in use and the squared length."""
    e = dense.both_spaces(_kept_chunks(spark, d, "chunk_id", "content"))
    return e.select("space", "chunk_id", F.size("slots").alias("slots"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w), 6).alias("squared"))


# ---- fusion and retrieval


@query
def rrf_fuse(spark, d):
    c, q = _kept_chunks(spark, d, "chunk_id", "content"), _questions(spark, d)
    return retrieve.fuse([dense.search(c, q), lexical.search(c, q)])


@query
def hybrid_search(spark, d):
    return retrieve.hybrid(_chunks(spark, d), _questions(spark, d)).select("query_id", "rank", "chunk_id", "similarity_score", "bm25_score", "rrf_score")


@query
def citation_label(spark, d):
    return _chunks(spark, d).select("chunk_id", retrieve.citation(F.col("title"), F.col("page_number"), F.col("start_line"), F.col("end_line")).alias("citation"))


@query
def cloud_policy_gate(spark, d):
    q = _questions(spark, d)
    return retrieve.gate(q, retrieve.hybrid(_chunks(spark, d), q))


@query
def request_errors(spark, d):
    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return retrieve.request_errors(turns).select("conv_id", "turn", F.col("error_code").cast("string").alias("error_code"))


@query
def context_block(spark, d):
    return retrieve.context(retrieve.hybrid(_chunks(spark, d), _questions(spark, d)))


@query
def fallback_answer(spark, d):
    q = _questions(spark, d)
    return retrieve.answers(q, retrieve.hybrid(_chunks(spark, d), q))


@query
def sse_events(spark, d):
    said = _t(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("answer"))
    return retrieve.events(said)


# ---- chunks


@query
def chunk_fixed(spark, d):
    return _chunks(spark, d).select("chunk_id", "chunk_index", "word_count", "page_number", "start_line", "end_line", "sha256")


@query
def chunk_recursive(spark, d):
    return chunk.recursive(collection.corpus(spark, d)).select("chunk_id", "doc_key", "chunk_index", "word_count", "page_number", "start_line", "end_line", "sha256")


@query
def chunk_stats(spark, d):
    return chunk.recursive(collection.corpus(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_key").alias("documents"), F.max(F.length("content")).alias("longest"), F.sum("word_count").alias("words"))


# ---- collection


@query
def ingest_validate(spark, d):
    return collection.validated(collection.from_documents(_t(spark, d, "documents"))).select("row_id", "title", "category", "sha256", "load_error")


@query
def dedup_sha256(spark, d):
    return collection.corpus(spark, d).select("doc_key", "row_id", "sha256", "category")


@query
def delete_document(spark, d):
    """Deletes every document of the category LEGAL: what stays, with its chunks."""
    docs = collection.corpus(spark, d)
    kept, chunks, _ = collection.delete_documents(docs, chunk.fixed(docs), docs.where("category = 'LEGAL'"))
    return kept.select("doc_key").join(chunks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("chunks")), "doc_key", "left").select("doc_key", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query
def reclassify(spark, d):
    """Documents in German become FINANCIAL, in French an unknown category."""
    raw = _t(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    docs = collection.corpus(spark, d)
    changes = docs.join(raw, "row_id").where("lang in ('de', 'fr')").select("doc_key", F.when(F.col("lang") == "de", "FINANCIAL").otherwise("UNHEARD_OF").alias("new_category"))
    return collection.reclassify(docs, changes).select("doc_key", "category")


@query
def manifest(spark, d):
    return collection.manifest(_chunks(spark, d))


@query
def manifest_check(spark, d):
    """The manifest of all chunks held against the chunks without the category LEGAL: none of its figures holds; and against all: each does."""
    c = _kept_chunks(spark, d)
    all_ = stored(collection.manifest(c), "manifest")
    check = lambda rows, name: collection.manifest_holds(rows, all_).withColumn("against", F.lit(name))
    return check(c, "all").unionByName(check(c.where("category <> 'LEGAL'"), "some"))


@query
def merkle_tree(spark, d):
    """All nodes of the Merkle tree over the chunks' ids, from that of the chunks without the category LEGAL, updated by the rest."""
    c = _kept_chunks(spark, d)
    whole, legal = merkle.entries(c, "chunk_id"), merkle.entries(c.where("category = 'LEGAL'"), "chunk_id")
    depth = merkle.depth_of(whole.count())
    before = merkle.tree(merkle.entries(c.where("category <> 'LEGAL'"), "chunk_id"), depth)
    return merkle.updated(before, whole, legal)[0]


@query
def collection_stats(spark, d):
    docs = collection.corpus(spark, d)
    n = chunk.fixed(docs).groupBy("category").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.groupBy("category").agg(F.count(F.lit(1)).alias("documents")).join(n, "category", "left").select("category", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"), collection.is_sensitive(F.col("category")).alias("sensitive"))


@query
def doc_filter(spark, d):
    return collection.matching(collection.corpus(spark, d), "SRC1").select("doc_key", "title", "category")


# ---- privacy


@query
def pii_type_counts(spark, d):
    return privacy.type_counts(_t(spark, d, "documents"), "doc_id")


@query
def pii_email_ip(spark, d):
    """E-mail addresses and IPv4 shapes in place, from built-in functions alone."""
    email, ip = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7})", r"((?:[0-9]{1,3}\.){3}[0-9]{1,3})"
    named = lambda name, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(name).alias("type"), x.alias("raw")))
    found = F.concat(named("EMAIL", email), named("IP_ADDRESS", ip))
    return _t(spark, d, "documents").select("doc_id", F.inline(found))


@query
def pii_redact(spark, d):
    out = privacy.redact(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "redacted_text", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit("@"), e["start_index"].cast("string"))), " ").alias("spans"))


@query
def pii_restore_roundtrip(spark, d):
    out = privacy.restore(privacy.redact(_t(spark, d, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.sha2("restored_text", 256).alias("sha256"), F.size("unknown_tokens").alias("unknown"))


@query
def pii_risk(spark, d):
    out = privacy.redact(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "risk", metrics.risk_band(F.col("risk")).alias("band"))


@query
def risk_band(spark, d):
    score = (F.col("quality") * 30 + F.col("toxic") * 40 + F.pmod("doc_id", F.lit(7))).cast("int")
    return _t(spark, d, "labels").select("doc_id", score.alias("score"), metrics.risk_band(score).alias("band"))


@query
def pii_overlap_resolve(spark, d):
    """The overlap sweep over the orders' shipping intervals as spans: each order's line items by day of the year."""
    day = F.dayofyear("l_shipdate")
    spans = F.collect_list(F.struct(day.alias("start"), (day + F.col("l_linenumber") * 5).alias("end"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence")))
    kept = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(privacy.resolved(spans).alias("kept"))
    return kept.select("l_orderkey", F.posexplode("kept").alias("i", "s")).select("l_orderkey", "i", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


# ---- grounding


def _answered(spark, d):
    q = _questions(spark, d)
    got = retrieve.hybrid(_chunks(spark, d), q)
    return retrieve.answers(q, got), got


@query
def extract_citations(spark, d):
    said, _ = _answered(spark, d)
    return said.select("query_id", F.posexplode(T.citations(F.col("answer"))).alias("i", "c")).select("query_id", "i", "c.name", "c.page", "c.first", "c.last")


@query
def extract_quotes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.quotes(F.col("text"))).alias("i", "quote"))


@query
def quote_match(spark, d):
    ev = grounding.with_evidence(*_answered(spark, d))
    found, held = grounding.quote_counts(F.col("answer"), F.col("chunks"))
    return ev.select("query_id", found.alias("quotes"), F.coalesce(held, F.lit(0)).alias("matched"))


@query
def claim_extract(spark, d):
    said = _t(spark, d, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", F.posexplode(grounding.claims_of(F.col("text"))).alias("i", "claim"))


@query
def claim_verify(spark, d):
    return grounding.claim_rows(grounding.with_evidence(*_answered(spark, d))).select("query_id", "claim_index", "status", "verifying_doc", "verifying_lines", "confidence")


@query
def grounding_report(spark, d):
    return grounding.report(*_answered(spark, d))


# ---- ledger


def _events(spark, d):
    """Each user's events as one ledger."""
    e = _t(spark, d, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    summary, data = ledger.local_query(F.col("event_type"), F.col("event_id"), F.col("event_id") % 2 == 0)
    rows = e.select(F.col("user_id").alias("ledger"), (F.row_number().over(by) - 1).cast("bigint").alias("idx"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit("LOCAL_QUERY").alias("event_type"), summary.alias("payload_summary"), data.alias("data"))
    return rows.withColumn("data_hash", ledger.data_hash(F.col("payload_summary"), F.col("data"))).drop("data")


@query
def ledger_data_hash(spark, d):
    return _events(spark, d).select("ledger", "idx", "payload_summary", "data_hash")


@query
def ledger_entries(spark, d):
    """Summary and data hash of every kind of ledger entry, dealt out over the events."""
    e, i, kind = _t(spark, d, "events"), F.col("event_id"), F.col("event_type")
    entities = F.pmod(i, F.lit(9))
    each = {
        "DOCUMENT_INGEST": ledger.document_ingest(kind, F.concat(F.lit("doc_"), i), F.lit("GENERAL"), T.sha256(i.cast("string")), i),
        "PII_REDACT": ledger.pii_redact(entities, privacy.risk(entities)),
        "LOCAL_QUERY": ledger.local_query(kind, i, i % 2 == 0),
        "AIR_GAP_VERIFY": ledger.air_gap_verify(i % 3 == 0, i),
        "QUANT_TELEMETRY": ledger.quant_telemetry(kind, F.lit("Q4"), i),
        "ERROR": ledger.error(kind, F.repeat(kind, F.lit(40))),
        "MODE_SWITCH": ledger.mode_switch(kind),
        "SYSTEM_SHUTDOWN": ledger.system_shutdown(kind),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("entry"), summary.alias("payload_summary"), ledger.data_hash(summary, data).alias("data_hash")) for name, (summary, data) in each.items()])
    return e.select("event_id", F.get(rows, F.pmod(i, F.lit(8)).cast("int")).alias("r")).select("event_id", "r.*")


@query
def text_decoding(spark, d):
    """Every text as the bytes of a file, in turn UTF-16 and UTF-8 with a byte-order mark, plain UTF-8 and, where its letters allow, Latin-1, and decoded again."""
    t = F.coalesce("text", F.lit(""))
    utf16 = lambda mark, name: F.concat(F.lit(mark), F.encode(t, name))
    plain = F.encode(t, "UTF-8")
    kind = F.pmod("doc_id", F.lit(5))
    latin = F.when(F.rlike(t, F.lit(r"^[\x00-\xFF]*+$")), F.encode(F.regexp_replace(t, r"[^\x00-\xFF]", ""), "ISO-8859-1")).otherwise(plain)
    content = F.when(kind == 0, utf16(b"\xff\xfe", "UTF-16LE")).when(kind == 1, utf16(b"\xfe\xff", "UTF-16BE")).when(kind == 2, F.concat(F.lit(b"\xef\xbb\xbf"), plain)).when(kind == 3, plain).otherwise(latin)
    rows = _t(spark, d, "documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", files.decoded(F.col("content")).alias("t")).select("doc_id", T.sha256(F.col("t")).alias("sha256"), F.length("t").alias("chars"))


@query
def ledger_json(spark, d):
    """Hash of every text as a JSON string, as the ledger's payloads hold texts: non-ASCII and control characters escaped."""
    return _t(spark, d, "documents").select("doc_id", F.sha2(ledger.json_text(F.col("text")), 256).alias("sha256"))


@query
def ingest_status(spark, d):
    """What becomes of every document: taken in with its chunks, a duplicate with none, or refused."""
    return collection.ingest_report(collection.from_documents(_t(spark, d, "documents")), chunk.fixed, most=60)[2]


@query
def ledger_chain(spark, d):
    return ledger.chained(_events(spark, d)).select("ledger", "idx", "previous_hash", "current_hash")


@query
def ledger_verify(spark, d):
    return ledger.verified(ledger.chained(_events(spark, d)))


@query
def ledger_tamper(spark, d):
    """Verification after the third record of every ledger was tampered with, by the ledger's number modulo 5: another data hash, repeated, missing, its place swapped with the next, left alone."""
    chain = stored(ledger.chained(_events(spark, d)), "chain").withColumn("place", F.col("idx"))
    kind, third = F.pmod("ledger", F.lit(5)), F.col("idx") == 2
    chain = chain.withColumn("data_hash", F.when((kind == 0) & third, F.lit("0" * 64)).otherwise(F.col("data_hash")))
    chain = chain.where(~((kind == 2) & third)).withColumn("place", F.when((kind == 3) & third, 3).when((kind == 3) & (F.col("idx") == 3), 2).otherwise(F.col("place")))
    return ledger.verified(chain.unionByName(chain.where((kind == 1) & third)), place="place")


@query
def ledger_filter(spark, d):
    e = _t(spark, d, "events")
    return ledger.filtered(e, "purchase").select("event_id", "event_type")


# ---- evaluation, telemetry, streams


@query
def nearest_rank_percentile(spark, d):
    return metrics.nearest_rank(_t(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


@query
def doc_match_accuracy(spark, d):
    """How often the fused best chunk is of the document of the best chunk by words alone."""
    c, q = _kept_chunks(spark, d, *retrieve.SHOWN), _questions(spark, d)
    near, words = retrieve.rankings(c, q)
    best = lambda df, name: df.where("rank = 1").select("query_id", F.substring_index("chunk_id", "_chunk_", 1).alias(name))
    return metrics.accuracy(best(words, "expected").join(best(retrieve.joined(c, q, near, words), "got"), "query_id", "left"), "expected", "got")


@query
def corpus_fingerprint(spark, d):
    return metrics.fingerprint(_t(spark, d, "documents"), "doc_id", "text")


@query
def memory_matrix(spark, d):
    return telemetry.memory(telemetry.sweep(spark, [2048, 4096, 8192, 16384, 32768], [1, 2, 4, 8]))


@query
def fits_flags(spark, d):
    m = telemetry.memory(telemetry.sweep(spark, [4096, 32768], [1, 4]))
    return m.groupBy("quant_type").agg(F.count_if("fits_16gib").alias("fit_16"), F.count_if("fits_8gib").alias("fit_8"))


@query
def ledger_event_counts(spark, d):
    return streams.event_counts(_t(spark, d, "events"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"


@query
def stream_ingest_dedup(spark, d):
    """The documents as a file stream, deduplicated against what earlier batches wrote."""
    at = _scratch(spark)
    schema = _t(spark, d, "documents").schema
    raw = collection.from_documents(spark.readStream.schema(schema).parquet(f"{d}/[d]ocuments.parquet"))
    streams.ingest_stream(raw, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/table").select("doc_key", "row_id", "sha256")


@query
def stream_ledger_chain(spark, d):
    """Each user's events as a ledger kept by a stream: the earlier half lands and is chained, then the later one, after a restart from the checkpoint."""
    at = _scratch(spark)
    e = _t(spark, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    half = F.lit(_t(spark, d, "events").agg(F.date_format(F.percentile_approx(F.col("ts").cast("timestamp"), 0.5), "yyyy-MM-dd'T'HH:mm:ss")).first()[0])
    for part, which in enumerate((F.col("ts") < half, F.col("ts") >= half)):
        e.where(which).write.parquet(f"{at}/landing/part={part}")
        rows = spark.readStream.schema(e.schema).parquet(f"{at}/landing")
        summary, data = ledger.local_query(F.col("event_type"), F.col("event_id"), F.col("event_id") % 2 == 0)
        rows = rows.select(F.col("user_id").alias("ledger"), "ts", F.col("event_id").alias("seq"), F.lit("LOCAL_QUERY").alias("event_type"), summary.alias("payload_summary"), ledger.data_hash(summary, data).alias("data_hash"))
        streams.ledger_stream(rows, f"{at}/ledger", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/ledger").select("ledger", "idx", "previous_hash", "current_hash")


@query
def stream_ledger_counts(spark, d):
    """Event counts as a stream with a watermark, in complete mode."""
    at = _scratch(spark)
    schema = _t(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/table")
    streams.event_counts(events).writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/table").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def host_telemetry(spark, d):
    return files.host_figures(spark)


@query
def page_text_load(spark, d):
    """Every page as a file of bytes: guards, decoding, normal lines."""
    pages = _t(spark, d, "pages").select(F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    out = files.load(pages.withColumn("length", F.length("content").cast("bigint")))
    return out.select("name", "kind", "sha256", "load_error", F.length("text").alias("chars"))
