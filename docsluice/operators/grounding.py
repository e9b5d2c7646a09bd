"""Grounding of answers in their retrieved chunks: citations, quotes, claims, score, verdict. All built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

QUOTE_SHARE, CITATION_SHARE, CLAIM_SHARE = 0.45, 0.25, 0.30
VERIFIED, INFERRED, GROUNDED = 0.50, 0.25, 0.70
SHORTEST_CLAIM = 15
REFUSAL = "do not contain information"


def claims_of(answer: Column) -> Column:
    """Sentences of an answer that state something: no blank, Note: or Based on lines, without citations and quote marks, 15 characters at least."""
    lines = F.filter(F.transform(F.split(answer, "\n"), T.strip), lambda s: (s != "") & ~F.startswith(s, F.lit("Note:")) & ~F.startswith(s, F.lit("Based on")))
    said = F.flatten(F.transform(lines, lambda s: T.sentences(s)))
    bare = F.transform(said, lambda s: T.strip(F.replace(T.without_citations(s), F.lit('"'), F.lit(""))))
    return F.filter(bare, lambda s: F.length(s) >= SHORTEST_CLAIM)


def with_evidence(answered: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers with their chunks as one array in the order of rank (20 at most for each query)."""
    chunk = F.struct("rank", F.col("title").alias("name"), F.col("content").alias("text"), "start_line", "end_line", F.array_distinct(T.word_tokens(F.col("content"))).alias("words"))
    held = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return answered.join(held, "query_id", "left")


def claim_rows(evidence: DataFrame) -> DataFrame:
    """(query_id, claim_index, claim_text, status, verifying_doc, verifying_lines, confidence, snippet): each claim and the chunk that shares most of its words, ties to the better rank."""
    rows = evidence.where(F.col("chunks").isNotNull() & ~F.contains(F.lower("answer"), F.lit(REFUSAL))).select("query_id", "chunks", F.posexplode(claims_of(F.col("answer"))).alias("i", "claim_text"))
    rows = rows.withColumn("words", F.array_distinct(T.word_tokens(F.col("claim_text")))).where(F.size("words") > 0)
    rated = F.transform("chunks", lambda c: F.struct((-F.size(F.array_intersect(F.col("words"), c["words"]))).alias("k"), c["rank"].alias("rank"), c.alias("c")))
    best = F.array_min(F.transform(rated, lambda x: F.struct(x["k"].alias("k"), x["rank"].alias("rank"), x["c"]["name"].alias("name"), x["c"]["start_line"].alias("a"), x["c"]["end_line"].alias("z"), F.left(x["c"]["text"], F.lit(80)).alias("text"))))
    rows = rows.withColumn("best", best).withColumn("share", -F.col("best.k") / F.size("words"))
    some = F.col("share") > 0
    status = F.when(F.col("share") >= VERIFIED, "VERIFIED").when(F.col("share") >= INFERRED, "INFERRED").otherwise("UNSUPPORTED")
    return rows.select(
        "query_id", F.col("i").alias("claim_index"), "claim_text", status.alias("status"), F.when(some, F.col("best.name")).alias("verifying_doc"), F.when(some, F.concat(F.col("best.a"), F.lit("-"), F.col("best.z"))).alias("verifying_lines"),
        F.round("share", 3).alias("confidence"), F.when(some, F.concat(F.col("best.text"), F.lit("..."))).alias("snippet"),
    )


def quote_counts(answer: Column, chunks: Column) -> tuple[Column, Column]:
    """Quotes found, and those that the chunks' text holds (blanks collapsed, any case; a quote may span chunks)."""
    found = T.quotes(answer)
    held = T.squeeze(F.array_join(F.transform(chunks, lambda c: c["text"]), " "))
    return F.size(found), T.let(held, lambda h: F.size(F.filter(found, lambda q: F.contains(h, T.squeeze(T.strip(q))))))


def citation_counts(answer: Column, chunks: Column) -> tuple[Column, Column]:
    """Citations found, and those whose name holds a chunk's or is held by it. No join: both sides are arrays of one row."""
    found = T.citations(answer)
    good = F.filter(found, lambda x: F.exists(chunks, lambda c: F.contains(F.lower(c["name"]), F.lower(T.strip(x["name"]))) | F.contains(F.lower(T.strip(x["name"])), F.lower(c["name"]))))
    return F.size(found), F.size(good)


def report(answered: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row for each answer with counts, scores, verdict and notes."""
    ev = with_evidence(answered, retrieved)
    c = claim_rows(ev).groupBy("query_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("VERIFIED", "INFERRED", "UNSUPPORTED")])
    q, qm = quote_counts(F.col("answer"), F.col("chunks"))
    x, xm = citation_counts(F.col("answer"), F.col("chunks"))
    refused, bare = F.contains(F.lower("answer"), F.lit(REFUSAL)), F.col("chunks").isNull()
    rows = ev.select("query_id", refused.alias("refused"), bare.alias("bare"), q.alias("q"), F.coalesce(qm, F.lit(0)).alias("qm"), x.alias("x"), F.coalesce(xm, F.lit(0)).alias("xm")).join(c, "query_id", "left").fillna(0, ["verified", "inferred", "unsupported"])
    plain = ~F.col("refused") & ~F.col("bare")
    total = F.col("verified") + F.col("inferred") + F.col("unsupported")
    raw = QUOTE_SHARE * F.when(F.col("q") > 0, F.col("qm") / F.col("q")).otherwise(1.0) + CITATION_SHARE * F.when(F.col("x") > 0, F.col("xm") / F.col("x")).otherwise(0.0) + CLAIM_SHARE * F.when(total > 0, F.col("verified") / total).otherwise(1.0)
    score = F.when(F.col("refused"), 1.0).when(F.col("bare"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3))
    loss = F.when(F.col("refused"), 0.0).when(F.col("bare"), 1.0).otherwise(F.greatest(F.lit(0.0), F.round(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)))
    rows = rows.select("query_id", "refused", "bare", *[F.when(plain, F.col(n)).otherwise(0).cast("bigint").alias(m) for n, m in (("x", "total_citations"), ("xm", "citations_verified"), ("q", "total_quotes"), ("qm", "quotes_matched"), ("verified", "claims_verified"), ("inferred", "claims_inferred"), ("unsupported", "claims_unsupported"))], score.alias("confidence"), loss.alias("unsupported_rate"), F.when(plain, total).otherwise(0).alias("total"))
    ok = F.col("refused") | (~F.col("bare") & (F.col("confidence") >= GROUNDED) & (F.col("claims_unsupported") <= F.floor(F.col("total") / 2)))
    verdict = F.when(F.col("refused"), "GROUNDED_REFUSAL (heuristic)").when(F.col("bare"), "NO_CONTEXT (heuristic)").when(ok, F.concat(F.lit("GROUNDED (heuristic score: "), F.col("confidence"), F.lit(")"))).otherwise(F.concat(F.lit("POTENTIAL_HALLUCINATION (heuristic score: "), F.col("confidence"), F.lit(")")))
    notes = F.when(F.col("refused"), F.array(F.lit("Grounded refusal: model confirmed context lacked requested facts."))).when(F.col("bare"), F.array(F.lit("No context chunks were retrieved."))).otherwise(
        F.array(
            F.concat(F.lit("Grounding confidence (heuristic): "), F.col("confidence")), F.concat(F.lit("Unsupported claim rate (heuristic): "), F.col("unsupported_rate")),
            F.concat(F.lit("Citations matched: "), F.col("citations_verified"), F.lit("/"), F.col("total_citations")), F.concat(F.lit("Verbatim quotes matched: "), F.col("quotes_matched"), F.lit("/"), F.col("total_quotes")),
            F.concat(F.lit("Claims matrix: "), F.col("claims_verified"), F.lit(" verified, "), F.col("claims_inferred"), F.lit(" inferred, "), F.col("claims_unsupported"), F.lit(" unsupported")),
        )
    )
    return rows.select("query_id", ok.alias("is_grounded"), "confidence", "unsupported_rate", "total_citations", "citations_verified", "total_quotes", "quotes_matched", "claims_verified", "claims_inferred", "claims_unsupported", verdict.alias("verdict"), F.array_join(notes, " | ").alias("notes"))
