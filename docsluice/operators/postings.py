"""A stored inverted index: postings in blocks with block bounds, segments, tombstones, and exact top-k that reads few blocks.

Rows of one add make a segment. Its chunks lie in ranges of RANGE, and each term
of a range has one postings row: the chunks, counts and lengths, with the
highest count and the least length as the block's bound. A range is inverted in
one place, and its rows travel to their buckets packed. A removal writes the
places of the removed chunks and how often each term leaves with them; nothing
is rewritten until ``compacted``. Statistics are those of the live chunks, so
scores equal those of an index built from them anew.

A search reads only block heads of its terms first. They bound what a range can
give to a query; the most promising ranges are read and scored, which gives a
score that k chunks reach, and of the rest only ranges are read whose bound is
as high. So results are exact. The blocks of PART ranges meet where they are
scored for all queries that read them, so that what leaves is the best of each
query, not a row for each chunk that holds a term.

Writes are batches (``functions.batches``): one that runs again does the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.batches import Batches
from ..functions.tables import stored
from . import lexical
from .dense import QUERY_BLOCK, _by_key, _pack, _unpack

RANGE = 256  # chunks of a range, a power of two
BUCKETS = 32  # folders of terms in a segment
SPREAD = 4  # files at most of a bucket and task round, so that a frequent bucket is no single task
PART = 32  # ranges that are scored at once, a power of two
FIRST = 4  # ranges of a query that are read first
CLOSE = 2e-6  # ranks go by six places

PLACE = ("seg", "rng", "doc")
DOCS = "rng bigint, doc int, chunk_id string, dl int, terms array<string>, tfs array<int>"
POSTINGS = "bucket int, term string, rng bigint, n int, max_tf int, min_dl int, docs array<int>, tfs array<int>, dls array<int>"
DEAD = "seg string, rng bigint, doc int, chunk_id string, dl int"
GONE = "term string, n bigint"
TOTALS = "n bigint, length bigint"


PACKED = "bucket int, rng bigint, terms string, ns binary, docs binary, tfs binary, dls binary"


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _lists(ends: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _least(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers as bytes, each number in one, two or four of them."""
    width = np.dtype("<u1" if values.max() < 1 << 8 else "<u2" if values.max() < 1 << 16 else "<u4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width.itemsize).astype(np.int32)), pa.py_buffer(values.astype(width))])


def _numbers(runs: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The numbers of all runs of ``_least``, of which each has so many."""
    return np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(runs.to_pylist(), counts.tolist(), strict=True)]).astype(np.int32)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(keys, prepend=-1))


def _inverted(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """The postings of one range: a row for each bucket, with its terms, in how many chunks each is, and those chunks."""
        words = pc.split_pattern(rows.column("terms").combine_chunks(), " ")
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        by = sorted(range(len(names)), key=lambda i: (zlib.crc32(names[i]) % buckets, names[i]))
        place = np.empty(len(names), np.int64)
        place[by] = np.arange(len(names))
        term, doc = place[coded.indices.to_numpy(zero_copy_only=False)], rows.column("doc").to_numpy()[row]
        order = np.lexsort((doc, term))
        n = np.bincount(term, minlength=len(names))
        bucket = np.array([zlib.crc32(names[i]) % buckets for i in by])
        cut = _starts(bucket)  # of terms
        ends = np.append(cut, len(names))
        entries = np.concatenate(([0], np.cumsum(n)))[ends]
        tfs, dls = rows.column("tfs").combine_chunks().flatten().to_numpy()[order], rows.column("dl").to_numpy()[row][order]
        terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(by, pa.int64()))), " ")
        rng = pa.array(np.full(len(cut), rows.column("rng")[0].as_py()), pa.int64())
        return pa.table({"bucket": pa.array(bucket[cut], pa.int32()), "rng": rng, "terms": terms, "ns": _least(n, ends), "docs": _least(doc[order], entries), "tfs": _least(tfs, entries), "dls": _least(dls, entries)})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED rows as POSTINGS."""
    for x in batches:
        if not x.num_rows:
            continue
        words = pc.split_pattern(x.column("terms"), " ")
        many = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        row, n = pa.array(np.repeat(np.arange(x.num_rows), many)), _numbers(x.column("ns"), many)
        entries = np.add.reduceat(n, np.cumsum(many) - many, dtype=np.int64)
        docs, tfs, dls = (_numbers(x.column(c), entries) for c in ("docs", "tfs", "dls"))
        ends = np.concatenate(([0], np.cumsum(n)))
        highest, least = np.maximum.reduceat(tfs, ends[:-1]), np.minimum.reduceat(dls, ends[:-1])
        out = [x.column("bucket").take(row), words.flatten(), x.column("rng").take(row), pa.array(n, pa.int32()), pa.array(highest, pa.int32()), pa.array(least, pa.int32()), _lists(ends, docs), _lists(ends, tfs), _lists(ends, dls)]
        yield pa.RecordBatch.from_arrays(out, names=["bucket", "term", "rng", "n", "max_tf", "min_dl", "docs", "tfs", "dls"])


def _together(blocks: pa.Table, reads: pa.Table) -> pa.Table:
    """The blocks of a part, and which queries read which of its ranges, as one row."""
    return pa.table({"seg": [reads.column("seg")[0].as_py()], "a": pa.array([_pack(blocks.select(["rng", "term", "docs", "tfs", "dls"]))], pa.binary()), "r": pa.array([_pack(reads.select(["rng", "query_id", "floor", "gone"]))], pa.binary())})


def _part_scores(size: int, k1: float, b: float, k: int):
    def one(seg: str, blocks: pa.Table, reads: pa.Table, gains: tuple, avgdl: float) -> pa.RecordBatch | None:
        """The chunks of one part that may be among the k best of a query that reads their range."""
        of = pc.fill_null(pc.index_in(blocks.column("term").combine_chunks(), gains[0]), -1).to_numpy(zero_copy_only=False)
        rngs, rng = np.unique(reads.column("rng").to_numpy(), return_inverse=True)
        at = np.minimum(np.searchsorted(rngs, blocks.column("rng").to_numpy()), len(rngs) - 1)
        known = (of >= 0) & (rngs[at] == blocks.column("rng").to_numpy())
        lists = blocks.column("docs").combine_chunks()
        many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(np.repeat(known, many))
        doc, tf, dl = (blocks.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)[held] for c in ("docs", "tfs", "dls"))
        s = lexical._summed(np.repeat(at, many)[held] * size + doc, np.repeat(of, many)[held], tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), len(rngs) * size, gains)
        query = pc.fill_null(pc.index_in(reads.column("query_id").combine_chunks(), gains[1]), -1).to_numpy(zero_copy_only=False)
        real = np.flatnonzero(query >= 0)
        floor = np.full((len(gains[1]), len(rngs)), np.inf)  # what a query does not read is below it
        floor[query[real], rng[real]] = reads.column("floor").to_numpy(zero_copy_only=False)[real] - lexical.CLOSE
        gone = reads.column("gone").combine_chunks()
        s[:, np.repeat(rng, pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)) * size + gone.flatten().to_numpy(zero_copy_only=False)] = 0.0
        s[s < np.repeat(floor, size, axis=1)] = 0.0
        q, c = np.nonzero(lexical._best(s, k))
        if not len(q):
            return None
        return pa.RecordBatch.from_arrays([gains[1].take(pa.array(q)), pa.array([seg] * len(q), pa.string()), pa.array(rngs[c // size], pa.int64()), pa.array(c % size, pa.int32()), pa.array(s[q, c])], names=["query_id", "seg", "rng", "doc", "bm25"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for x in batches:
            for seg, a, r, asked in zip(*x.columns, strict=True):
                if last is None or last[0] != asked.as_py():
                    block = _unpack(asked)
                    last = (asked.as_py(), lexical._gains(block), block.column("avgdl")[0].as_py())
                out = one(seg.as_py(), _unpack(a), _unpack(r), *last[1:])
                if out is not None:
                    yield out

    return run


class PostingsIndex(Batches):
    """An index in the folder ``path``, which driver and executors share."""

    # ---- changes

    def add(self, chunks: DataFrame, batch: str) -> None:
        """Chunks (chunk_id, content) of one batch, each id once. A chunk_id that is live is replaced. ``batch`` names the segment; the same name again does the same work again. Ids are read before the texts: pass a stored table."""
        self.remove(chunks.select("chunk_id"), f"{batch}-replaced", but=batch)
        tokens = chunks.select("chunk_id", T.bm25_tokens(F.col("content")).alias("tokens"))
        self._segment(tokens.select("chunk_id", F.size("tokens").alias("dl"), T.counts(F.col("tokens")).alias("x")), batch)

    def _segment(self, rows: DataFrame, batch: str) -> None:
        """rows: chunk_id, dl, x (array of term and tf)."""
        n = F.monotonically_increasing_id()
        docs = rows.select(F.shiftright(n, RANGE.bit_length() - 1).alias("rng"), n.bitwiseAND(F.lit(RANGE - 1)).cast("int").alias("doc"), "chunk_id", "dl", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))
        self._write(docs, "add", batch, "docs")
        docs = self.spark.read.schema(DOCS).parquet(f"{self.path}/add/{batch}/docs")
        each = docs.where(F.size("terms") > 0).select("rng", "doc", "dl", F.array_join("terms", " ").alias("terms"), "tfs")
        blocks = each.groupBy("rng").applyInArrow(_inverted(BUCKETS), PACKED)  # at most RANGE chunks a group
        blocks = blocks.repartition("bucket", F.pmod(F.xxhash64("rng"), F.lit(SPREAD))).mapInArrow(_unpacked, POSTINGS)
        self._write(blocks.sortWithinPartitions("bucket", "term", "rng"), "add", batch, "postings", "bucket")
        self._write(docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("length")), "add", batch, "done")

    def remove(self, ids: DataFrame, batch: str, but: str | None = None) -> None:
        """Tombstones for live chunks with the ids (chunk_id). Unknown ids change nothing. ``but``: a segment that is left alone."""
        live = self.live(but, batch)
        self._write(live.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("seg", "rng", "doc", "chunk_id", "dl"), "remove", batch, "docs")
        dead = self.spark.read.schema(DEAD).parquet(f"{self.path}/remove/{batch}/docs")
        terms = live.select(*PLACE, "terms").join(dead.select(*PLACE), [*PLACE], "left_semi").select(F.explode("terms").alias("term"))
        self._write(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "remove", batch, "terms")
        self._write(dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("length")), "remove", batch, "done")

    def compacted(self, path: str, batch: str = "whole") -> PostingsIndex:
        """The live chunks as one segment of a new index."""
        out = PostingsIndex(self.spark, path)
        out._segment(self.live().select("chunk_id", "dl", F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")).alias("x")), batch)
        return out

    # ---- reading

    def dead(self, but: str | None = None) -> DataFrame:
        """Places of removed chunks, save by the removal ``but``."""
        return self._read("remove", "docs", DEAD, but).select(*PLACE)

    def live(self, but: str | None = None, unremoved: str | None = None) -> DataFrame:
        """(seg, rng, doc, chunk_id, dl, terms, tfs) of every live chunk, save of the segment ``but`` and as if the removal ``unremoved`` had not been."""
        return self._read("add", "docs", DOCS, but).withColumnRenamed("batch", "seg").join(self.dead(unremoved), [*PLACE], "left_anti")

    def statistics(self) -> DataFrame:
        """One row: n and avgdl of the live chunks."""
        held, gone = (self._read(kind, "done", TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")) for kind in ("add", "remove"))
        both = held.crossJoin(F.broadcast(gone.toDF("n2", "length2")))  # one row each
        n, length = F.col("n") - F.col("n2"), F.col("length") - F.col("length2")
        return both.select(n.alias("n"), F.when(n > 0, length / n).otherwise(0.0).alias("avgdl"))

    def search(self, queries: DataFrame, k: int = lexical.TOP, k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
        """(query_id, chunk_id, score, rank): what ``lexical.top`` gives for the live chunks."""
        return self.searched(queries, k, k1, b)[0]

    def searched(self, queries: DataFrame, k: int = lexical.TOP, k1: float = lexical.K1, b: float = lexical.B) -> tuple[DataFrame, DataFrame]:
        """The result, and (query_id, blocks, blocks_read): postings blocks of the query's terms, and those that were read."""
        asked = stored(lexical.query_terms(queries).withColumn("bucket", _bucket(F.col("term"))), "asked")
        postings = self._read("add", "postings", POSTINGS).withColumnRenamed("batch", "seg")
        terms = asked.select("bucket", "term").distinct()
        heads = stored(postings.select("seg", "bucket", "term", "rng", "n", "max_tf", "min_dl").join(terms, ["bucket", "term"]), "heads")
        held = heads.groupBy("term").agg(F.sum("n").alias("n"))
        gone = self._read("remove", "terms", GONE).groupBy("term").agg(F.sum("n").alias("gone"))
        df = held.join(gone, "term", "left").select("term", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("df")).where("df > 0")
        weights = df.crossJoin(F.broadcast(self.statistics()))  # one row
        weights = stored(asked.join(weights, "term").select("query_id", "bucket", "term", "qtf", F.col("n").alias("total"), "df", "avgdl"), "weights")
        gain = lambda tf, dl: F.col("qtf") * lexical.weight(F.col("total"), F.col("df"), F.col(tf), F.col(dl), F.col("avgdl"), k1, b)
        bounds = heads.drop("n").join(weights, ["bucket", "term"]).groupBy("query_id", "seg", "rng").agg(F.sum(gain("max_tf", "min_dl")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "rng")
        bounds = stored(bounds, "bounds")
        first = stored(bounds.select("*", F.row_number().over(order).alias("r")).where(F.col("r") <= FIRST).select("query_id", "seg", "rng", F.lit(0.0).alias("floor")), "first")
        asking = stored(_by_key(weights.withColumnRenamed("total", "n").drop("bucket"), "query_id", max(1, -(-queries.count() // QUERY_BLOCK)), "b"), "asking")
        gone = self.dead().groupBy("seg", "rng").agg(F.collect_list("doc").alias("gone"))  # at most RANGE a row
        part = F.shiftright("rng", PART.bit_length() - 1).alias("part")
        kind = queries.schema["query_id"].dataType.simpleString()

        def scored(pairs: DataFrame) -> DataFrame:
            """(query_id, seg, rng, doc, bm25) of the live chunks of ranges that may be among a query's k best: each part gives its own best that reach the floor."""
            some = stored(pairs.select("seg", "rng").distinct(), "ranges")
            blocks = postings.join(terms, ["bucket", "term"]).join(some, ["seg", "rng"]).select("seg", part, "rng", "term", "docs", "tfs", "dls")
            none = F.array().cast("array<int>")
            reads = pairs.select("seg", part, "rng", "query_id", "floor", none.alias("gone"))
            reads = reads.unionByName(gone.join(some, ["seg", "rng"]).select("seg", part, "rng", F.lit(None).cast(kind).alias("query_id"), F.lit(0.0).alias("floor"), "gone"))
            met = blocks.groupBy("seg", "part").cogroup(reads.groupBy("seg", "part")).applyInArrow(_together, "seg string, a binary, r binary")
            return met.crossJoin(asking).mapInArrow(_part_scores(RANGE, k1, b, k), f"query_id {kind}, seg string, rng bigint, doc int, bm25 double")

        early = stored(scored(first), "early")
        kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floors = early.select("query_id", F.round("bm25", 6).alias("score")).where("score > 0").withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select("query_id", "score")
        rest = bounds.join(first.drop("floor"), ["query_id", "seg", "rng"], "left_anti").join(floors, "query_id", "left")
        rest = stored(rest.where(F.col("score").isNull() | (F.col("bound") >= F.col("score") - CLOSE)).select("query_id", "seg", "rng", F.coalesce("score", F.lit(0.0)).alias("floor")), "rest")
        names = self._read("add", "docs", "rng bigint, doc int, chunk_id string").withColumnRenamed("batch", "seg")
        found = early.unionByName(scored(rest)).join(names, [*PLACE]).select("query_id", "chunk_id", "bm25")
        read = bounds.join(first.unionByName(rest).drop("floor").withColumn("read", F.lit(True)), ["query_id", "seg", "rng"], "left")
        report = read.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("read"), F.col("blocks")).otherwise(0)).alias("blocks_read"))
        return lexical.top(found, k=k), report


_counts = T.counts
