"""Hash embeddings and flat inner-product search."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashes, tokens
from ..functions import text as T
from ..functions import vectors as V
from ..functions.tables import parted, stored

TOP = 20
CHUNK_BLOCK, QUERY_BLOCK = 8192, 2048
PIECE, BLOCK_BYTES = 1024, 1 << 24  # rows that join a block at once; what closes it before it has all its rows
FOUND = "query_id bigint, chunk_id string, similarity double"
CLOSE = 2e-6  # ranks go by six places; what is this near to the kth score is kept for them


WORDS = 1 << 16  # words whose hashes are made at once; a longer text goes by itself
BLOCK_WORDS = 1 << 20  # the same where a block of texts becomes vectors, so that its words are hashed once


def _words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the words of each text between blanks, which no word holds."""
    return rows.select(key, F.array_join(T.content_words(F.col(text)), " ").alias("words"))


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, words): texts whose words ``tokens.content`` finds in blocks."""
    return rows.select(key, *tokens.columns(F.col(text), T.word_tokens))


def _hashed(make: str, names: hashes.Strings) -> np.ndarray:
    """Digests as rows of 32-bit numbers, the highest first."""
    return hashes.digests(make, names)


def _slots(digests: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``V.hex_slot`` and ``V.hex_sign`` of digests."""
    slot = np.zeros(len(digests), np.int64)
    for column in digests.T:
        slot = (slot * ((1 << 32) % dim) + column) % dim
    return slot, np.where(digests[:, -1] >> 8 & 1, 1.0, -1.0)


def _cells(at: np.ndarray, words: pa.Array, to: np.ndarray, dims: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each space the cells (row * dim + slot) and what is added there: +-(1 + 1/(place+1)) of each word, +-1.5 of each pair of neighbours.

    ``at`` gives the text of each word, in order, ``to`` the row of each text;
    each distinct word and pair is hashed once.
    """
    coded = words if pa.types.is_dictionary(words.type) else words.dictionary_encode()
    names, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    second = np.flatnonzero(place > 0)
    pairs = pa.array(of[second - 1] * len(names) + of[second]).dictionary_encode()
    pair_of, (a, b) = pairs.indices.to_numpy(zero_copy_only=False), np.divmod(pairs.dictionary.to_numpy(), max(1, len(names)))
    one = _hashed("md5", hashes.Strings(names))
    two = _hashed("sha1", hashes.Strings(pc.binary_join_element_wise(names.take(pa.array(a)), names.take(pa.array(b)), "_")))
    row = to[at]
    for dim in dims:
        (slot, sign), (pair_slot, pair_sign) = _slots(one, dim), _slots(two, dim)
        yield dim, np.concatenate((row * dim + slot[of], row[second] * dim + pair_slot[pair_of])), np.concatenate((sign[of] * (1 + 1 / (place + 1)), pair_sign[pair_of] * 1.5))


def _cut(texts: pa.Array | pa.ChunkedArray, most: int) -> Iterator[slice]:
    """Runs of texts with some ``most`` words between blanks, or one text."""
    sizes = np.cumsum(pc.add(pc.count_substring(texts, " "), 1).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def _flat(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text of each word, and the words."""
    lists = pc.split_pattern(texts, " ")
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    at, real = np.repeat(np.arange(len(texts)), counts), pc.not_equal(words, "")
    return at[real.to_numpy(zero_copy_only=False)], words.filter(real)


def _unit(sums: np.ndarray) -> np.ndarray:
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return sums / np.where(length == 0, 1.0, length)


def _embedder(dims: tuple[int, ...], unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.not_equal(b.column(1), ""))
            for some in _cut(b.column(1), WORDS):
                part = b.slice(some.start, some.stop - some.start)
                n = part.num_rows
                for dim, cell, value in _cells(*_flat(part.column(1)), np.arange(n), dims):
                    sums, used = np.bincount(cell, value, n * dim).reshape(n, dim), np.bincount(cell, minlength=n * dim).reshape(n, dim) > 0
                    row, slot = np.nonzero(used)
                    weight = (_unit(sums) if unit else sums)[row, slot]
                    ends = pa.array(np.concatenate(([0], np.cumsum(used.sum(axis=1)))), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, dim, np.int32)), part.column(0), pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight))], names=["dim", b.schema.names[0], "slots", "weights"])

    return run


def embeddings(rows: DataFrame, key: str, text: str, dims: tuple[int, ...]) -> DataFrame:
    """(dim, key, slots, weights) of unit length in each space. Rows without any word have no row: their vector is zero.

    A text is hashed where it lies, without a shuffle; only rows that share a
    key are summed by key and slot. The keys are read beforehand.
    """
    once, more = parted(rows.select(key, text), key)
    schema = f"dim int, `{key}` {rows.schema[key].dataType.simpleString()}, slots array<int>, weights array<double>"
    out = _words(once, key, text).mapInArrow(_embedder(dims, True), schema)
    if more is None:
        return out
    sums = _words(more, key, text).mapInArrow(_embedder(dims, False), schema).select("dim", key, F.inline(F.arrays_zip(F.col("slots").alias("slot"), F.col("weights").alias("weight"))))
    whole = sums.groupBy("dim", key, "slot").agg(F.sum("weight").alias("weight")).groupBy("dim", key).agg(F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("v"))
    return out.unionByName(whole.select("dim", key, F.col("v.slot").alias("slots"), V.normalised(F.col("v.weight")).alias("weights")))


def embed(rows: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, slots, weights) of unit length, as of ``embeddings``."""
    return embeddings(rows, key, text, (dim,)).drop("dim")


def _matrix(slots: list, weights: list, dim: int) -> np.ndarray:
    out = np.zeros((len(slots), dim))
    at = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    if len(at):
        out[at, np.concatenate([np.asarray(s, np.int64) for s in slots])] = np.concatenate([np.asarray(w, float) for w in weights])
    return out


def _given(rows: pa.Table, key: str, dim: int) -> tuple[list, np.ndarray]:
    """Ids and vectors of a block of (key, slots, weights)."""
    return rows.column(key).to_pylist(), _matrix(rows.column("slots").to_pylist(), rows.column("weights").to_pylist(), dim)


def _made(rows: pa.Table, key: str, dim: int) -> tuple[list, np.ndarray]:
    """Ids and vectors of a block of (key, words) or (key, text, words); rows that share a key are one vector, those without words none."""
    if "text" in rows.column_names:
        at, words = tokens.content(rows.column("text").combine_chunks(), rows.column("words").combine_chunks())
        used = np.zeros(rows.num_rows, bool)
        used[at] = True
        rows, at = rows.filter(pa.array(used)), (np.cumsum(used) - 1)[at]
        cuts = np.append(np.searchsorted(at, at[BLOCK_WORDS::BLOCK_WORDS]), len(at))  # between texts
        words = words if len(cuts) == 1 else words.dictionary_decode()  # a part hashes its own words alone
        parts = [(at[a:z], words[a:z]) for a, z in zip(np.append(0, cuts[:-1]), cuts, strict=True) if z > a]
    else:
        rows = rows.filter(pc.not_equal(rows.column("words"), ""))
        texts = rows.column("words")
        parts = ((row + part.start, each) for part in _cut(texts, BLOCK_WORDS) for row, each in [_flat(texts[part].combine_chunks())])
    coded = rows.column(key).combine_chunks().dictionary_encode("encode")
    of, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    out = np.zeros(n * dim)
    for at, words in parts:
        for _, cell, value in _cells(at, words, of, (dim,)):
            out += np.bincount(cell, value, n * dim)
    return coded.dictionary.to_pylist(), _unit(out.reshape(n, dim))


def _block_top(vectors, dim: int, k: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        """The best chunks of one block for each query of one block."""
        rows = ([], [], [])
        if chunks.num_rows and queries.num_rows:
            (ids, a), (qids, b) = vectors(chunks, "chunk_id", dim), vectors(queries, "query_id", dim)
            for q, s in zip(qids, b @ a.T, strict=True):
                least = np.partition(s, len(s) - k)[len(s) - k] - CLOSE if len(s) > k else -np.inf
                for i in np.nonzero(s >= least)[0].tolist():
                    rows[0].append(q)
                    rows[1].append(ids[i])
                    rows[2].append(float(s[i]))
        return pa.table({"query_id": pa.array(rows[0], pa.int64()), "chunk_id": pa.array(rows[1], pa.string()), "similarity": pa.array(rows[2], pa.float64())})

    return run


def _pack(rows: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue()


def _unpack(block: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_py()).read_all()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, some ``CHUNK_BLOCK`` or ``BLOCK_BYTES`` of them as one row."""
    held = []
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            held.append(b.slice(at, PIECE))
            if sum(x.num_rows for x in held) >= CHUNK_BLOCK or sum(x.nbytes for x in held) >= BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([_pack(pa.Table.from_batches(held))], pa.binary())], names=["a"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_pack(pa.Table.from_batches(held))], pa.binary())], names=["a"])


def _by_key(rows: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
    """Rows as blocks by a hash of the key, so that those of one key are in one block."""
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    pack = lambda t: pa.table({name: pa.array([_pack(t.drop_columns("part_"))], pa.binary())})
    return rows.withColumn("part_", part).groupBy("part_").applyInArrow(pack, f"{name} binary")


def met(a: DataFrame, b: DataFrame, m: int, run, schema: str, single: bool = False) -> DataFrame:
    """``run`` over every block of ``a`` (chunk_id, ...) with every block of ``b`` (query_id, ...), the latter of about m ids.

    Both sides meet in blocks of bounded size, so a task holds few of each.
    Rows of ``a`` become blocks where they lie; only rows that share a chunk_id,
    which ``single`` rules out, are shuffled, so that they are in one block. Those
    that share a query_id are in one block too.
    """
    once, more = (a, None) if single else parted(a, "chunk_id")
    left = once.mapInArrow(_blocks, "a binary")
    if more is not None:
        left = left.unionByName(_by_key(more, "chunk_id", max(1, -(-more.count() // CHUNK_BLOCK)), "a"))
    right = stored(_by_key(b, "query_id", max(1, -(-m // QUERY_BLOCK)), "b"), "asked")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in batches:
            for x, y in zip(pair.column(0), pair.column(1), strict=True):
                yield from run(_unpack(x), _unpack(y)).to_batches()

    return left.crossJoin(right).select("a", "b").mapInArrow(pairs, schema)


def search(chunks: DataFrame, queries: DataFrame, dim: int = 384, k: int = TOP, single: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k highest inner products of each query, by six places, ties by chunk_id.

    Blocks hold texts, which become vectors where they meet the queries, as
    these are several times larger. Each block gives its own best, and a window
    picks the final ones. Chunks are read twice (ids and texts): pass a stored table. ``single``: no two chunks share a chunk_id.
    """
    found = met(_texts(chunks, "chunk_id", "content"), _texts(queries, "query_id", "query"), queries.count(), _block_top(_made, dim, k), FOUND, single)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


CLOUD_DIM = 768


def search_space(chunks: DataFrame, queries: DataFrame, mode: str, space: str = "local", k: int = TOP) -> DataFrame:
    """Search in the local (384) or the cloud (768) space. The cloud space is refused in airgap mode, before any job runs."""
    if space not in ("local", "cloud") or mode not in ("airgap", "cloud"):
        raise ValueError(f"unknown space or mode: {space}, {mode}")
    if space == "cloud" and mode == "airgap":
        raise PermissionError("the cloud space must not be searched in airgap mode")
    return search(chunks, queries, CLOUD_DIM if space == "cloud" else 384, k)


def both_spaces(chunks: DataFrame) -> DataFrame:
    """(space, chunk_id, slots, weights): the embeddings of both spaces, as ``sinks.vectors`` writes them."""
    both = embeddings(chunks, "chunk_id", "content", (384, CLOUD_DIM))  # words are cut and hashed once for both
    return both.select(F.when(F.col("dim") == CLOUD_DIM, "cloud").otherwise("local").alias("space"), "chunk_id", "slots", "weights")


def index_update(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """An index (chunk_id and any columns) without the ids of ``removed`` and with ``added``, which replace rows of their ids."""
    out = index
    for gone in (removed, added):
        if gone is not None:
            out = out.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return out if added is None else out.unionByName(added)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Flat search of supplied dense vectors: (query_id, vec_id, score, rank) by cosine, both sides made of unit length. Queries: query_id and v; vectors: vec_id and v. A query's own row competes too."""
    dense = lambda df, key, name: df.where(F.size("v") > 0).select(F.col(key).cast("string" if name == "chunk_id" else "bigint").alias(name), F.sequence(F.lit(0), F.size("v") - 1).alias("slots"), V.normalised(F.col("v")).alias("weights"))
    a, b = dense(vectors, "vec_id", "chunk_id"), dense(queries, "query_id", "query_id")
    figures = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first() for df in (vectors, queries)]
    found = met(a, b, figures[1]["n"], _block_top(_given, max(1, *(f["dim"] for f in figures)), k), FOUND, single=True)  # rows of one id are vectors of their own
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = found.select("query_id", F.col("chunk_id").cast("bigint").alias("vec_id"), F.round("similarity", 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
