"""The corpus pipeline: language ID, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsluice.llm import jaccard, langid, mixing, packing
from docsluice.llm.common import stored, table

STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("source_mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL expresses none of the compression classifier, the packing and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
