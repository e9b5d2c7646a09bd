"""Exact Jaccard join of word-shingle sets, by signature trees inside small candidate clusters.

Steps, none of which pairs documents up:

1. Every document becomes its set of distinct shingle hashes (64 bits) and a
   128-bit digest of the set; documents with equal sets are one set from here.
2. Sieve. Under the order of hashes, two linked sets share their first L
   common elements within known prefixes. Prefix elements of all documents
   travel as packed arrays to the ranges of their hash; back come those that
   other documents hold too, with how many. A document with fewer than L of
   them can link with nothing and is done.
3. Among its prefix elements, ordered from the rarest, a set of L common ones
   has one within the first (length - L + 1). These, with the class of size,
   are the keys of a document; each key ties its sets to the smallest (a
   star). The components of the ties are clusters; linked sets share one.
4. In a cluster, sets are the leaves of a tree whose nodes hold OR-combined
   bitmaps and ranges of size. A traversal of node pairs prunes those whose
   greatest possible overlap is too small, and those already in one component;
   the pairs of leaves that remain are compared exactly. Clusters above
   BLOCK_ELEMENTS or BLOCK_SETS are dealt out as pairs of blocks, each a task of its own.

Defined cases: null texts and texts without words have an empty set, link with
nothing and are their own component. Fewer words than a shingle: the whole
sequence is one shingle. Repeated rows are copies. Only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, gathered, mix64, modest, slices, split_words, spread_join, stored, worked
from .components import components

WORDS, THRESHOLD = 5, (4, 5)  # of the general interface
EXTRA = (3, 10)  # share of a set that the sieve takes beyond its short prefix
SIEVE_BYTES = 8 << 20  # text of one sieve block
RANGE_ELEMENTS = 4_000_000  # elements of one hash range
BLOCK_ELEMENTS, BLOCK_SETS = 4_000_000, 8192  # elements and sets of one block of a cluster
BUNDLE_ELEMENTS = 1_000_000
BITMAP_WORDS, FANOUT = 64, 8
_ODD = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    most = max(0, len(h) - words + 1)
    full = np.full(most, words, np.uint64)
    for j in range(words):
        full = mix64(full * _ODD + h[j : j + most])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(full[at : at + n - words + 1]))
        elif n:
            acc = np.array([n], np.uint64)
            for j in range(n):
                acc = mix64(acc * _ODD + h[at + j : at + j + 1])
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_id(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    a = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix64(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b ^ np.uint64(len(s))).to_bytes(8, "big")


def _need(n: int, t: tuple[int, int]) -> int:
    """The smallest overlap that a set of n elements can link with."""
    return -(-t[0] * n // t[1])


def _extra(n: int) -> int:
    return max(1, EXTRA[0] * n // EXTRA[1])


def _classes(t: tuple[int, int]) -> np.ndarray:
    """Lower ends of classes of size: sets that link are of one class or of neighbours."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * t[1] // t[0] + 1)
    return np.array(ends)


def _digest(df: DataFrame, key: str, text: str, words: int, t: tuple[int, int], bits: int) -> DataFrame:
    """The sieve's table: for each block of documents one row (part -1) of ids, sizes and digests, and rows of packed prefix elements by hash range."""
    id_type = df.schema[key].dataType.simpleString()
    schema = f"block bigint, part int, packed binary, ids array<{id_type}>, sizes array<int>, sids array<binary>"
    arrow_ids = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = counter(TaskContext.get().partitionId() << 32)

        def blocks(wide: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo in range(0, wide.num_rows, 50_000):
                b = wide.slice(lo, 50_000)
                sets = shingle_sets(b.column(text), words)
                block = next(numbers)
                sizes = np.array([len(s) for s in sets], np.int32)
                heads = [s[: n - _need(n, t) + _extra(n)] for s, n in zip(sets, sizes.tolist(), strict=True)]
                flat = mix64(np.concatenate(heads)) if heads else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(heads), dtype=np.uint16), [len(x) for x in heads])
                order = np.argsort(flat)
                flat, doc = flat[order], doc[order]
                part = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
                low = ((flat << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
                rows = [(int(part[a]), low[a:z].tobytes() + doc[a:z].astype("<u2").tobytes()) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                ids = b.column(key)
                k = len(rows) + 1
                ends = pa.array([0, len(ids)] + [len(ids)] * (k - 1), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * k, pa.int64()), pa.array([-1] + [p for p, _ in rows], pa.int32()), pa.array([None] + [d for _, d in rows], pa.binary()),
                        pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(sizes, pa.int32())), pa.ListArray.from_arrays(ends, pa.array([set_id(s) for s in sets], pa.binary())),
                    ],
                    names=["block", "part", "packed", "ids", "sizes", "sids"],
                )

        yield from worked(gathered(batches, text, SIEVE_BYTES), blocks)

    return df.mapInArrow(run, schema)


def _shared(key: tuple, group: pa.Table) -> pa.Table:
    """In one hash range: the elements that occur in more than one document, with how many hold them."""
    packed = group.column("packed").to_pylist()
    sizes = np.array([len(p) // 6 for p in packed])
    low = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(packed, sizes.tolist(), strict=True)])
    doc = np.concatenate([np.frombuffer(p, "<u2", n, 4 * n) for p, n in zip(packed, sizes.tolist(), strict=True)])
    both = np.sort(low.astype(np.uint64) << np.uint64(32) | np.arange(len(low), dtype=np.uint64))
    value = both >> np.uint64(32)
    first = np.nonzero(np.concatenate(([True], value[1:] != value[:-1])))[0]
    times = np.diff(np.append(first, len(value)))
    df = np.zeros(len(low), np.uint16)
    df[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(np.minimum(times, 65535).astype(np.uint16), times)
    ends, out = np.cumsum(sizes), []
    for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        some = df[a:z] > 1
        out.append(low[a:z][some].tobytes() + doc[a:z][some].tobytes() + df[a:z][some].tobytes())
    return pa.table({"block": group.column("block"), "part": pa.array([key[0].as_py()] * len(out), pa.int32()), "packed": pa.array(out, pa.binary())})


def _ties(t: tuple[int, int]):
    ends = _classes(t)

    def run(group: pa.Table) -> pa.Table:
        """Of one block: for each document that the sieve leaves, its rarest shared elements as keys, for its class of size and the next."""
        sizes, sids, low, doc, df, part = [], [], [], [], [], []
        for r in group.to_pylist():
            if r["packed"] is None:
                sizes, sids = np.array(r["sizes"], np.int64), r["sids"]
            else:
                n = len(r["packed"]) // 8
                low.append(np.frombuffer(r["packed"], "<u4", n))
                doc.append(np.frombuffer(r["packed"], "<u2", n, 4 * n))
                df.append(np.frombuffer(r["packed"], "<u2", n, 6 * n))
                part.append(np.full(n, r["part"], np.uint64))
        keys, who = [], []
        if low and len(sizes):
            low, doc, df, part = (np.concatenate(x) for x in (low, doc, df, part))
            place = part << np.uint64(32) | low
            order = np.lexsort((place, df, doc))
            place, upto = place[order], np.searchsorted(doc[order], np.arange(len(sizes) + 1))
            for i, n in enumerate(sizes.tolist()):
                own = place[upto[i] : upto[i + 1]]
                least = _extra(_need(n, t))
                if n and len(own) >= least:
                    # elements of no other document come first in the order, so the rest of the prefix is what remains
                    own = own[: len(own) - least + 1]
                    c = int(np.searchsorted(ends, n, "right"))
                    for k in (c, c + 1):
                        keys.append(mix64(own ^ mix64(np.array([k], np.uint64))))
                        who.append((i, len(own)))
        if not keys:
            return pa.table({"key": pa.array([], pa.int64()), "sid": pa.array([], pa.binary())})
        at = np.repeat([i for i, _ in who], [n for _, n in who])
        return pa.table({"key": pa.array(np.concatenate(keys).view(np.int64)), "sid": pa.array(sids, pa.binary()).take(pa.array(at))})

    return run


def _sets_of(df: DataFrame, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            sets = shingle_sets(b.column(text), words)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["sid", "size", "elements"])

    return df.select(text).mapInArrow(run, "sid binary, size int, elements binary")


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class SignatureTree:
    """Levels of nodes over sets in order of size. Level 0 are the sets; a node stands for FANOUT nodes below it.

    A node keeps the OR of its bitmaps, its least and greatest size, and its
    slack: the most by which a set below exceeds its own number of bits.
    """

    def __init__(self, sets: list[np.ndarray]):
        maps = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
        row = np.zeros(BITMAP_WORDS * 64, bool)
        for i, s in enumerate(sets):
            at = (s & np.uint64(BITMAP_WORDS * 64 - 1)).astype(np.int64)
            row[at] = True
            maps[i] = np.packbits(row).view(np.uint64)
            row[at] = False
        size = np.array([len(s) for s in sets])
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, t: tuple[int, int]) -> np.ndarray:
        """Whether node pairs may hold a linked pair, by size and by the greatest possible overlap."""
        maps, low, high, slack = self.levels[level]
        common = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[i], high[j]), common + np.minimum(slack[i], slack[j]))
        fits = (t[1] * high[i] >= t[0] * low[j]) & (t[1] * high[j] >= t[0] * low[i])
        return fits & ((t[0] + t[1]) * most >= t[0] * (low[i] + low[j]))


def links(sets: list[np.ndarray], t: tuple[int, int], cross: np.ndarray | None = None) -> Forest:
    """Components of the linked sets. ``sets`` must be in order of size. With ``cross`` (a side 0 or 1 for each set) links within one side need not be found."""
    forest = Forest(len(sets))
    tree = SignatureTree(sets)
    top = len(tree.levels) - 1
    work = [(top, 0, 0)]
    while work:
        level, i, j = work.pop()
        if level == 0:
            if i != j and (cross is None or cross[i] != cross[j]) and forest.root(i) != forest.root(j):
                a, b = sets[i], sets[j]
                same = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                if t[1] * same >= t[0] * (len(a) + len(b) - same):
                    forest.join(i, j)
            continue
        span = FANOUT**level
        if i != j:
            members = {forest.root(x) for n in (i, j) for x in range(n * span, min(len(sets), (n + 1) * span))}
            if len(members) == 1:
                continue
        below = len(tree.levels[level - 1][0])
        left, right = np.arange(i * FANOUT, min(below, (i + 1) * FANOUT)), np.arange(j * FANOUT, min(below, (j + 1) * FANOUT))
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        if i == j:
            a, b = a[a <= b], b[a <= b]
        keep = tree.possible(level - 1, a, b, t) | (a == b)
        pairs = list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))
        pairs.sort(key=lambda p: (p[0] != p[1], p), reverse=True)  # the last is taken first: nodes with themselves
        work += [(level - 1, x, y) for x, y in pairs]
    return forest


def _cluster_ties(rows: list[tuple], t: tuple[int, int], crossing: bool) -> Iterator[tuple[bytes, bytes]]:
    """Ties (set, smallest set of its component) among rows (size, sid, block, elements) of one cluster or block pair."""
    rows = sorted(rows, key=lambda r: r[:2])
    forest = links([np.frombuffer(r[3], "<u8") for r in rows], t, np.array([r[2] for r in rows]) if crossing else None)
    least: dict[int, bytes] = {}
    for x, r in enumerate(rows):
        root = forest.root(x)
        least[root] = min(least.get(root, r[1]), r[1])
    for x, r in enumerate(rows):
        if least[forest.root(x)] != r[1]:
            yield r[1], least[forest.root(x)]


def _clusters(t: tuple[int, int]):
    def run(group: pa.Table) -> pa.Table:
        """A bundle of small clusters, or one block pair of a large one."""
        apart: dict[tuple, list] = {}
        for r in group.to_pylist():
            apart.setdefault((r["label"], r["i"], r["j"]), []).append((r["size"], r["sid"], r["blk"], r["elements"]))
        ties = [x for k in sorted(apart) for x in _cluster_ties(apart[k], t, k[1] != k[2])]
        return pa.table({"a": pa.array([x for x, _ in ties], pa.binary()), "b": pa.array([y for _, y in ties], pa.binary())})

    return run


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``.

    component_id is the smallest key that links reach, the row's own included.
    ``threshold`` is a ratio (numerator, denominator) of intersection to union.
    """
    t = threshold
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = int(size / 12 / RANGE_ELEMENTS).bit_length()  # some 12 bytes of text for each element that is sent
    digest = stored(_digest(docs, "key", "text", words, t, bits), "sieve")
    shared = digest.where("part >= 0").select("part", "block", "packed").groupBy("part").applyInArrow(_shared, "block bigint, part int, packed binary")
    sides = digest.where("part < 0").select("block", "part", F.lit(None).cast("binary").alias("packed"), "sizes", "sids")
    left = shared.select("block", "part", "packed", F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("array<binary>").alias("sids")).unionByName(sides)
    held = stored(left.groupBy("block").applyInArrow(_ties(t), "key bigint, sid binary"), "ties")
    stars = held.groupBy("key").agg(F.min("sid").alias("b"), F.max("sid").alias("z"), F.count(F.lit(1)).alias("many")).where(F.col("b") != F.col("z")).drop("z")
    clusters = stored(components(spread_join(held, stars, "key", held.count()).select(F.col("sid").alias("a"), "b")), "clusters")
    every = digest.where("part < 0")
    rows = every.select(F.explode(F.arrays_zip("ids", "sizes", "sids")).alias("x")).select(F.col("x.ids").alias("key"), F.col("x.sizes").alias("n"), F.col("x.sids").alias("sid"))
    total = every.agg(F.sum(F.size("ids")).alias("n")).first()["n"] or 0
    # one document stands for each set
    named = clusters.select(F.col("node").alias("sid"), "label")
    each = rows.where("n > 0").groupBy("sid").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("many"))
    chosen = each.join(named, "sid").select(F.col("first").alias("key"))
    kept = docs.alias("d").join(chosen.distinct().alias("c"), F.col("d.key").eqNullSafe(F.col("c.key")), "left_semi")
    fresh = _sets_of(kept, "text", words).join(named, "sid").groupBy("sid", "label").agg(F.min(F.struct("size", "elements")).alias("s"))
    member = stored(fresh.select("sid", "s.size", "s.elements", "label"), "members")
    blocks = member.groupBy("label").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_ELEMENTS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("many"))
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    whole = member.agg(F.sum("size")).first()[0] or 0
    dealt = spread_join(member, blocks, "label", member.count()).withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "sid", "size", "elements", "blocks")
    # small clusters travel in bundles of about BUNDLE_ELEMENTS, as each group of an Arrow call has its cost
    bundle = F.when(F.col("blocks") > 1, F.xxhash64("label", "i", "j")).otherwise(F.pmod(F.xxhash64("label"), F.lit(1 + int(whole) // BUNDLE_ELEMENTS)))
    found = dealt.withColumn("bundle", bundle).drop("blocks").groupBy("bundle").applyInArrow(_clusters(t), "a binary, b binary")
    if most > 1:
        labels = components(found)
    else:
        found = stored(found, "links")
        labels = found.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    # sets without a link skip the join of labels: as nulls they would all meet in one task
    each = each.join(labels, each["sid"] == labels["node"], "left").select("sid", "first", "label", "many")
    tied = each.where("label is not null")
    whole = tied.groupBy("label").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("many"))
    tied = spread_join(tied.withColumnRenamed("many", "copies"), whole, "label", total).select("sid", F.coalesce("least", "first").alias("component"), F.col("copies").alias("many"))
    each = tied.unionByName(each.where("label is null").select("sid", F.col("first").alias("component"), "many"))
    linked = spread_join(rows.where("n > 0"), stored(each, "sets"), "sid", total).select("key", "n", "component")
    alone = rows.where("n = 0").select("key", "n", F.col("key").alias("component"))
    return linked.unionByName(alone).select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"))


SQL = r"""
  WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
  sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
  each AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
  links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  reach(x, y) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
  least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
  SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, y AS component_id FROM sized JOIN least ON doc_id = x"""


def document_links(documents: DataFrame) -> DataFrame:
    return jaccard_components(documents, words=3, threshold=(90, 100))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of the smallest doc_id in it. Where a doc_id repeats, its rows are told apart by their text: each belongs to its own text's group, and a repeated row (same doc_id and text) stays once."""
    modest(spark)
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.isEmpty():
        found = jaccard_components(docs.select("doc_id", "text"))
        first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
        return docs.alias("d").join(first.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left_semi")
    (row,) = free_names(("row",), docs.columns)
    rows = stored(docs.dropDuplicates(["doc_id", "text"]).withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(row, "text"), key=row)
    first = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("x"))
    return rows.join(first.select(f"x.{row}"), row, "left_semi").select(docs.columns)
