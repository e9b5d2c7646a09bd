"""Tokens of a public tokenizer, and the exact histogram of document lengths.

The tokenizer lowers case and drops white space, so words between ASCII white
space are encoded apart from each other. Each distinct word of a slice is
encoded once; a bounded memory keeps words met before. Ids are those that
encoding the whole text gives (a test compares them).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gathered, split_words, stored

END_ID = 1
MEMORY_WORDS = 300_000  # words of one generation; a worker keeps two, about 120 MB
SLICE = 6 << 20
#: How the byte-level model writes bytes as characters: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: How the tokenizer cuts lower-cased text, for words of printable ASCII.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_KEPT: dict[str, "WordTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Special tokens (``<|endoftext|>``) in a text are what the tokenizer takes them for by default: one id each."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.inner.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def _encode(self, words: list[str]) -> None:
        """ASCII words are cut as the tokenizer cuts them, and words of Latin letters are one piece: these go to the model at once. The rest take the whole route."""
        known, pieces, tokenize, special, other = self.known, self.pieces, self.inner.model.tokenize, self.special, []
        for w in words:
            if w.isascii():
                low = w.lower()
                if low.isalpha():
                    known[w] = array("I", [t.id for t in tokenize(low)]).tobytes()
                    continue
                if w.isprintable() and not any(x in w for x in special):
                    parts = []
                    for p in _CUT.findall(low):
                        got = pieces.get(p)
                        if got is None:
                            got = pieces[p] = known.get(p) or array("I", [t.id for t in tokenize(p)]).tobytes()
                        parts.append(got)
                    known[w] = b"".join(parts)
                    continue
            elif w.isalpha() and max(w) <= "\u00ff":
                known[w] = array("I", [t.id for t in tokenize(w.lower().encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
                continue
            other.append(w)
        if other:
            for w, e in zip(other, self.inner.encode_batch_fast(other, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each of some distinct words."""
        if len(self.known) > MEMORY_WORDS:
            self.older, self.known = self.known, {}  # words not met again for a generation go
        if len(self.pieces) > MEMORY_WORDS:
            self.pieces = {}
        known, older = self.known, self.older
        each = list(map(known.get, words))
        gone = [i for i, v in enumerate(each) if v is None]
        fresh = []
        for i in gone:
            got = older.get(words[i])
            if got is None:
                fresh.append(words[i])
            else:
                known[words[i]] = got
        self._encode(fresh)
        for i in gone:
            each[i] = known[words[i]]
        return each

    def encode(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts in a row (None without ``ids``) and the number of each text."""
        # a special token counts in its own spelling only, so where one may stand nothing is lowered beforehand
        words, counts = split_words(texts, not pc.any(pc.match_substring(texts, "<|")).as_py())
        coded = words.dictionary_encode()
        each = self.ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        of = coded.indices.to_numpy(zero_copy_only=False)
        own = size[of]
        upto = np.concatenate(([0], np.cumsum(own)))
        lengths = np.diff(upto[np.concatenate(([0], np.cumsum(counts)))])
        if not ids:
            return None, lengths
        begin = np.cumsum(size) - size
        place = np.repeat(begin[of] - upto[:-1], own)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(each), "<u4")[place], lengths


def token_lengths(df: DataFrame, text: str = "text", path: str | None = None, end: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and n_tokens: the ids of each text plus ``end`` closing ids. Null text counts as empty."""
    path = path or default_path()
    schema = df.select(*keep, F.lit(0).cast("bigint").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.at(path)
        for b in gathered(batches, text, SLICE):
            _, n = tok.encode(b.column(text), ids=False)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(n + end, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(text, *[k for k in keep if k != text]).mapInArrow(run, schema)


SPAN = 1024  # lengths of one bucket when the suffix sums are made


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row for each length: n_docs, n_tokens and suffix sums.

    docs_ge and tokens_ge count documents at least so long. truncated_tokens
    is what stays of the whole corpus if each document is cut to ``length``
    tokens; cut_docs how many lose some. rank_from and rank_to are the first
    and last place (from 1) of this length in the order of lengths, so a
    quantile q is the row with rank_from <= ceil(q * total_docs) <= rank_to.
    Suffix sums run inside buckets of SPAN lengths and over the buckets'
    totals, so no task holds more than a bucket or one row for each bucket.
    The counts are stored first, as three steps read them and each would count
    (and tokenize) again. An empty table gives no row; null lengths are left out.
    """
    counts = stored(lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counts = counts.withColumn("bucket", F.floor(F.col("length") / SPAN)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    whole = totals.agg(F.sum("d").alias("total_docs"), F.sum("t").alias("total_tokens"))
    after = totals.select(F.col("bucket"), F.coalesce(F.sum("d").over(above), F.lit(0)).alias("more_docs"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("more_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(after, "bucket").crossJoin(F.broadcast(whole))
    rows = rows.select("length", "n_docs", "n_tokens", (F.sum("n_docs").over(inside) + F.col("more_docs")).alias("docs_ge"), (F.sum("n_tokens").over(inside) + F.col("more_tokens")).alias("tokens_ge"), "total_docs", "total_tokens")
    return rows.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"), (F.col("docs_ge") - F.col("n_docs")).alias("cut_docs"),
        (F.col("total_docs") - F.col("docs_ge") + 1).alias("rank_from"), (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")).alias("rank_to"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each stated context limit: documents cut and tokens kept. One pass over the histogram."""
    lines = [F.struct(F.lit(x).cast("bigint").alias("context_limit"), F.sum(F.least("length", F.lit(x)) * F.col("n_docs")).alias("kept_tokens"), F.sum(F.when(F.col("length") > x, F.col("n_docs")).otherwise(0)).alias("cut_docs")) for x in limits]
    return hist.agg(F.array(*lines).alias("a")).select(F.inline("a"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Nearest-rank quantiles of the length."""
    asked = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("q")
    at = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total_docs")))
    return hist.select("*", asked).where(at.between(F.col("rank_from"), F.col("rank_to"))).select("q", "length")


def document_lengths(documents: DataFrame) -> DataFrame:
    return histogram(token_lengths(documents))
