"""Language by compression: the raw-content dictionary that makes a text smallest names its language.

Each language's dictionary is plain training text. zstandard compresses the
whole text with each dictionary; the smallest result wins. A long text goes as
consecutive blocks, each of which starts from the dictionary again: together
they fit the window, so every byte is compared, and the sizes are summed.
``margin`` is the gap between the two smallest as a share of the second. A text
is rejected where the margin is below ``reject_margin``, or where it has no letter.

Training reads a bounded sample: distinct texts of any length in the order of
their hash until a language has ``DICT_BYTES``; a text above ``TEXT_BYTES``
gives a piece of that size from a place that its hash names. So each language
with a labelled text has a dictionary. Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, free_names, modest, slices, worked

DICT_BYTES = 96 << 10  # training text kept for a language
TEXT_BYTES = 8 << 10  # what one text gives to a dictionary at most
SAMPLE_ROWS = 400  # distinct texts sought for a language before the byte limit cuts
BLOCK_BYTES = 64 << 10  # with the dictionary well inside the window of 256 KB
LEVEL = 9
MIN_MATCH = 3
REJECT_MARGIN = 0.004
SOFTNESS = 3.0  # bytes by which a competitor may lose before its weight falls by e


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary of each language from rows with text and language.

    The distinct texts of each language are counted first, about; a threshold
    on the text's hash then brings a few hundred a language to the driver, so
    the sample stays bounded at every size. Copies of a text count once.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for l, n in counts.items() for v in (l, min(1.0, SAMPLE_ROWS / n))])
    place = (F.col("h").cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    begin = F.pmod("h", F.greatest(F.length("t") - TEXT_BYTES, F.lit(0)) + 1) + 1
    piece = F.substring("t", begin.cast("int"), F.lit(TEXT_BYTES))
    sample = rows.where(place <= F.element_at(share, F.col("l"))).select("l", "h", piece.alias("t")).groupBy("l", "h").agg(F.min("t").alias("t"))
    out: dict[str, bytes] = {}
    for r in sample.orderBy("l", "h").toLocalIterator():
        have = out.setdefault(r["l"], b"")
        if len(have) < DICT_BYTES:
            out[r["l"]] = have + encoded(r["t"])[: min(TEXT_BYTES, DICT_BYTES - len(have))] + b"\n"
    return out


def encoded(text: str) -> bytes:
    """What is compressed: the whole text in lower case, with its digits, signs and combining marks."""
    return text.lower().encode()


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICT_BYTES, source_size=DICT_BYTES + 4096, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def blocks(data: bytes) -> list[bytes]:
    """The whole text in consecutive parts of about one size, none above BLOCK_BYTES."""
    n = -(-len(data) // BLOCK_BYTES)
    cuts = [i * len(data) // n for i in range(n + 1)]
    return [data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def judge(text: str | None, models: list, reject_margin: float = REJECT_MARGIN) -> tuple[str, float, float, bool]:
    """Language, score, margin, rejected. Ties go to the name first in order (and are rejected, as their margin is 0)."""
    if not text or not models or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    parts = blocks(encoded(text))
    sizes = sorted((sum(len(c.compress(p)) for p in parts), name) for name, c in models)
    best = sizes[0][0]
    margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    score = 1.0 / sum(math.exp((best - s) / SOFTNESS) for s, _ in sizes)
    return sizes[0][1], score, margin, margin < reject_margin


RESULT = ("lang_pred", "score", "margin", "rejected")


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", reject_margin: float = REJECT_MARGIN, names: tuple[str, ...] = RESULT) -> DataFrame:
    """Add lang_pred, score (0 to 1), margin and rejected, under ``names``; columns of ``df`` with these names are replaced.

    Null text, empty text and text without a letter give ``und``, 0, 0, true;
    so does every row if there is no dictionary. Texts of any length are judged
    alike. Repeated rows stay.
    """
    own = [n for n in df.columns if n not in names]
    values = (F.lit(""), F.lit(0.0), F.lit(0.0), F.lit(True))
    schema = df.select(*[F.col(f"`{n}`") for n in own], *[v.alias(n) for v, n in zip(values, names, strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = compressors(dictionaries)

        def judged(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            got = [judge(t, models, reject_margin) for t in b.column(text).to_pylist()]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in own] + cols, names=[*own, *names])

        yield from worked(slices(batches, text), judged)

    return df.select(*[F.col(f"`{n}`") for n in own]).mapInArrow(run, schema)


def document_languages(documents: DataFrame) -> DataFrame:
    """Languages of all documents; learned from the rows whose crc32(doc_id) mod 4 is not 2 (a null doc_id is a training row)."""
    fold = doc_fold("doc_id", 4)
    models = train(documents.where(fold != 2))
    rows = documents.select("doc_id", (fold == 2).alias("held_out"), "text")
    return predict(rows, models).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain. Their columns stay as they are, whatever their names; repeated rows stay."""
    modest(spark)
    models = train(docs.where(doc_fold("doc_id", 4) != 2))
    names = free_names(RESULT, docs.columns)
    return predict(docs, models, names=names).where(~F.col(names[3])).select(*[F.col(f"`{n}`") for n in docs.columns])
