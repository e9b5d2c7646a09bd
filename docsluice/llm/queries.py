"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, ctw, flac, jaccard, langid, maintext, mixing, packing, tokens, urlrules, vafile, warc, whitening
from .common import table


def queries() -> dict:
    return {
        "op1_media_flac": lambda spark, d: flac.document_media(table(spark, d, "documents")),
        "op2_language_id": lambda spark, d: langid.document_languages(table(spark, d, "documents")),
        "op3_best_fit_packing": lambda spark, d: packing.document_sequences(table(spark, d, "documents")),
        "op4_token_counts": lambda spark, d: tokens.document_lengths(table(spark, d, "documents")),
        "op5_ngram_jaccard": lambda spark, d: jaccard.document_links(table(spark, d, "documents")),
        "op6_warc_derivatives": lambda spark, d: warc.page_derivatives(table(spark, d, "pages")),
        "op7_exact_topk": lambda spark, d: vafile.embedding_neighbours(table(spark, d, "embeddings")),
        "op8_lm_scoring": lambda spark, d: ctw.document_scores(table(spark, d, "documents")),
        "op9_url_filters": lambda spark, d: urlrules.page_verdicts(table(spark, d, "pages")),
        "op10_source_mixing": lambda spark, d: mixing.document_mix(table(spark, d, "documents")),
        "op11_embedding_whitening": lambda spark, d: whitening.embedding_whitening(table(spark, d, "embeddings")),
        "op12_main_text": lambda spark, d: maintext.page_texts(table(spark, d, "pages")),
        "op13_centroid_clustering": lambda spark, d: centroids.embedding_clusters(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": jaccard.SQL, "op7_exact_topk": vafile.SQL, "op6_warc_derivatives": warc.sql(), "op9_url_filters": urlrules.sql_of(), "op12_main_text": maintext.SQL, "op13_centroid_clustering": centroids.SQL}
