"""Language-model scores by context-tree weighting over whole texts.

A text is its tokens: lower-cased words, each closed by a blank, then one end
symbol. A byte is eight binary decisions. The context of a decision is the bits
before it in the byte and the DEPTH bytes before the byte, over blanks into the
words before it; in front of a text stand an end symbol and zeros. Each node
(context of 0 to DEPTH bytes, bits so far) has its own Krichevsky-Trofimov
estimate. A node's weighted probability is half its own and half the product of
its children's; these weights, from the whole training text, mix the estimates
of all depths when a byte is scored. One departure from plain context-tree
weighting: where training never met a context, its parent's estimate counts
alone, in place of mixing in the one half of an empty node.

Documents are read in blocks. A block sends each of its distinct (context, byte)
once, with its training count, to ranges of the nearest TOP bytes; a range
builds its subtrees, the tops of the subtrees meet by their nearest two bytes,
and the sums of depth 1 (at most 256 * 255 rows, whatever the corpus) give the
root on the driver. The mixture goes down the same way, and each block gets one
figure back for each thing it sent. Words travel likewise for the token counts.
No key gathers rows: a block, a range of words or a range of contexts is a
number of packed arrays.

Defined cases: null and empty texts are the end symbol alone. With no training
row, counts are zero, base_score is the sum of log10(1 / 1) and every binary
decision costs one bit. Repeated rows count as often as they stand. Null
doc_ids train (their remainder is never 2). Only the id and the text are read,
so other columns may have any name. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, gathered, mix64, release, split_words, stored, tidy

DEPTH = 7  # bytes of context
TOP = 4  # the nearest bytes, which name a context's range
BLOCK_BYTES = 20 << 20
PART_BYTES = 1_500_000  # bytes of a block that are sorted at once
RANGE_WORDS = 600_000  # distinct words of blocks in one range
RANGE_ENTRIES = 1_500_000  # distinct (context, byte) of blocks in one range, about
CHUNK = 300_000  # of them in one subtree computation, unless one TOP-byte context has more
SPAN = 8  # bytes that a key can hold, and that stand before each text
HEAD = "\0" * (SPAN - 1) + "\n"
FAR = 0xFFFFFFFF >> 8 * (SPAN - DEPTH) << 8 * (SPAN - DEPTH)  # of the four far bytes those within DEPTH
LOG2 = math.log(2)
TABLE = 1 << 16


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as planes of their bytes, compressed: high bytes are mostly zero."""
    return _squeeze(b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in columns))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def _joined(packed: list[bytes], *kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """Packed columns of many rows one after the other, and how many each row has."""
    apart = [_unpack(p, *kinds) for p in packed]
    return [np.concatenate([a[i] for a in apart]) for i in range(len(kinds))], np.array([len(a[0]) for a in apart])


def _rounded(a: np.ndarray) -> np.ndarray:
    """32-bit floats with 14 significant bits, which is what a figure keeps on its way back to the block."""
    return ((np.ascontiguousarray(a, np.float32).view(np.uint32) + np.uint32(0x200)) & np.uint32(0xFFFFFC00)).view(np.float32)


def _pack_words(words: list[bytes]) -> bytes:
    return _squeeze(b"\n".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers (Stirling's series beyond 8)."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    if low.any():
        z = x[low]
        prod = np.ones_like(z)
        for i in range(8):
            prod *= z + i
        out[low] -= np.log(prod)
    return out


_HALF, _ONE = lgamma(np.arange(TABLE) + 0.5), lgamma(np.arange(TABLE) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones (whole numbers)."""
    n = a + b
    if n.max(initial=0) < TABLE:
        return _HALF[a] + _HALF[b] - _ONE[n] - math.log(math.pi)
    out = np.empty(len(n))
    small = n < TABLE
    out[small] = _HALF[a[small]] + _HALF[b[small]] - _ONE[n[small]]
    out[~small] = lgamma(a[~small] + 0.5) + lgamma(b[~small] + 0.5) - lgamma(n[~small] + 1.0)
    return out - math.log(math.pi)


def halved(kt: np.ndarray, kids: np.ndarray) -> np.ndarray:
    """log of half the own and half the children's probability."""
    gap = np.abs(kt - kids)
    return np.maximum(kt, kids) + np.log1p(np.exp(-gap)) - LOG2


def arranged(high: np.ndarray, low: np.ndarray, byte: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(high, low, byte) in order, and their former places: 32, 32 and 8 bits, two sorts of one part of the key together with the place."""
    n = len(high)
    place = np.arange(n, dtype=np.uint64)
    if byte is not None and n > 1 << 24:
        order = np.lexsort((byte, low, high)).astype(np.uint32)
        return high[order], low[order], byte[order], order
    room = np.uint64(32 if byte is None else 24)
    mixed = low.astype(np.uint64)
    mixed <<= np.uint64(32)
    if byte is not None:
        mixed |= byte.astype(np.uint64) << room
    mixed |= place
    mixed.sort()
    mask = (np.uint64(1) << room) - np.uint64(1)
    lead = high[(mixed & mask).astype(np.uint32)].astype(np.uint64)
    lead <<= np.uint64(32)
    lead |= place
    lead.sort()
    mixed = mixed[lead.astype(np.uint32)]
    order = (mixed & mask).astype(np.uint32)
    return (lead >> np.uint64(32)).astype(np.uint32), low[order] if byte is None else (mixed >> np.uint64(32)).astype(np.uint32), None if byte is None else (mixed >> room).astype(np.uint8), order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys in order, and the place of each key among them."""
    order = arranged((keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32))[3]
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], back


class Entries:
    """The distinct (context, byte) of texts or of other entries: near and far half of the context, byte; ``order`` and ``starts`` lead back."""

    def __init__(self, near: np.ndarray, far: np.ndarray, byte: np.ndarray):
        near, far, byte, self.order = arranged(near, far, byte)
        new = np.ones(len(near), bool)
        new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1]) | (byte[1:] != byte[:-1])
        self.starts = np.flatnonzero(new)
        self.near, self.far, self.byte = near[self.starts], far[self.starts], byte[self.starts]

    def sums(self, n: np.ndarray) -> np.ndarray:
        """``n`` of what went in, summed for each entry."""
        return np.add.reduceat(n[self.order].astype(np.int64), self.starts) if len(self.starts) else np.zeros(0, np.int64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The value of the entry of each thing that went in, in the order of the entries."""
        return np.repeat(values, np.diff(np.append(self.starts, len(self.order))))

    def back(self, values: np.ndarray) -> np.ndarray:
        """The value of the entry of each thing that went in."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = self.spread(values)
        return out


class Stream:
    """Bytes of texts given as words and the number of each. ``size`` has the bytes of each text."""

    def __init__(self, words: pa.Array, lengths: np.ndarray):
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")
        tail = pa.array([" \n" if n else "\n" for n in lengths.tolist()], pa.string())
        whole = pc.binary_join_element_wise(HEAD, text, tail, "")
        ends = np.frombuffer(whole.buffers()[1], np.int32)[: len(whole) + 1].astype(np.int64) if len(whole) else np.zeros(1, np.int64)
        self.flat = np.frombuffer(whole.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
        self.ends, self.size = ends, np.diff(ends) - SPAN

    def parts(self) -> Iterator[tuple[Entries, np.ndarray]]:
        """Entries in order, about PART_BYTES bytes at a time by the byte before, and the text of each of their bytes."""
        if not len(self.size):
            return
        four = np.ndarray((len(self.flat) - 3,), "<u4", buffer=self.flat, strides=(1,))
        real = np.ones(len(self.flat), bool)
        for i in range(SPAN):
            real[self.ends[:-1] + i] = False
        before = np.concatenate((np.zeros(1, np.uint8), self.flat[:-1]))
        upto = np.cumsum(sum(np.bincount(before[i : i + PART_BYTES][real[i : i + PART_BYTES]], minlength=256) for i in range(0, len(real), PART_BYTES)))
        first = 0
        while first < 256:
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + PART_BYTES, "right")))
            if upto[last - 1] > done:
                at = np.flatnonzero((before >= first) & (before <= last - 1) & real)
                doc = (np.searchsorted(self.ends, at, "right") - 1).astype(np.uint32)
                yield Entries(four[at - 4], four[at - 8] & np.uint32(FAR), self.flat[at]), doc
            first = last


class Subtree:
    """The nodes of depth TOP to DEPTH over entries in order. Works bit by bit, so it holds the nodes of one bit at a time."""

    def __init__(self, near: np.ndarray, far: np.ndarray, byte: np.ndarray, counts: np.ndarray):
        wide, f, b = near.astype(np.uint64), far.astype(np.uint64), byte.astype(np.uint64)
        fresh = np.ones(len(near), bool)
        fresh[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        self.fresh, self.keys, self.counts, self.maps = fresh, {DEPTH: b}, {DEPTH: counts}, {}
        up = (wide << np.uint64(32) | f) >> np.uint64(8 * (SPAN + 1 - DEPTH)) << np.uint64(8) | b
        for d in range(DEPTH - 1, TOP - 1, -1):
            self.keys[d], self.maps[d] = grouped(up)
            self.counts[d] = np.bincount(self.maps[d], self.counts[d + 1], len(self.keys[d])).astype(np.int64)
            up = self.keys[d] >> np.uint64(16) << np.uint64(8) | self.keys[d] & np.uint64(0xFF)

    def climb(self, bit: int) -> dict:
        """For each depth the nodes of one bit: node of each entry, its first entry, zeros, ones, log of the weighted probability, parent."""
        out = {}
        for d in range(DEPTH, TOP - 1, -1):
            value = self.keys[d] >> np.uint64(8 - bit)
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            if d == DEPTH:
                new |= self.fresh
            first, n = np.flatnonzero(new), self.counts[d]
            node = np.cumsum(new) - 1
            ones = np.add.reduceat(n * (self.keys[d] >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64), first)
            zeros = np.add.reduceat(n, first) - ones
            kt = log_kt(zeros, ones)
            if d < DEPTH:
                below = out[d + 1]
                below["parent"] = node[self.maps[d][below["first"]]]
                weighted = halved(kt, np.bincount(below["parent"], below["weighted"], len(first)))
            else:
                weighted = kt
            out[d] = {"node": node, "first": first, "zeros": zeros, "ones": ones, "kt": kt, "weighted": weighted}
        return out

    def place(self, bit: int, first: np.ndarray) -> np.ndarray:
        """Key of nodes of depth TOP: the context's bytes, then the bits so far below a leading one."""
        key = self.keys[TOP][first]
        return key & ~np.uint64(0xFF) | (key & np.uint64(0xFF)) >> np.uint64(8 - bit) | np.uint64(1 << bit)

    def tops(self) -> tuple[np.ndarray, ...]:
        parts = []
        for bit in range(8):
            x = self.climb(bit)[TOP]
            parts.append((self.place(bit, x["first"]), x["zeros"], x["ones"], x["weighted"]))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def log10(self, keys: np.ndarray, upper: list[np.ndarray]) -> np.ndarray:
        """log10 of each entry's byte; ``upper`` is the mixture at nodes of depth TOP, for ``keys`` in order."""
        prob = np.ones(len(self.fresh))
        for bit in range(8):
            nodes = self.climb(bit)
            at = np.searchsorted(keys, self.place(bit, nodes[TOP]["first"]))
            state = [u[at] for u in upper]
            for d in range(TOP + 1, DEPTH + 1):
                x = nodes[d]
                state = lowered([s[x["parent"]] for s in state], x["zeros"], x["ones"], x["kt"], x["weighted"])
            one = state[0][nodes[DEPTH]["node"]]
            prob *= np.where(self.keys[DEPTH] >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one)
        return np.log10(prob)


def lowered(state: list[np.ndarray], zeros, ones, kt, weighted) -> list[np.ndarray]:
    """One depth down. The state of a node: probability of a one if the mixture ends here, what is mixed so far, weight that is left."""
    end, mixed, left = state
    total = zeros + ones
    met = total > 0
    own = (ones + 0.5) / (total + 1)
    share = np.exp(np.minimum(kt - LOG2 - weighted, 0))
    return [np.where(met, mixed + left * own, end), mixed + left * share * own, left * (1 - share)]


def raised(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes one depth up, as (keys, zeros, ones, kt, weighted), and the parent of each given node."""
    up, parent = grouped(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(0xFF))
    z, o = (np.bincount(parent, n, len(up)).astype(np.int64) for n in (zeros, ones))
    kt = log_kt(z, o)
    return up, z, o, kt, halved(kt, np.bincount(parent, weighted, len(up))), parent


def chunks(near: np.ndarray) -> list[tuple[int, int]]:
    """Parts of entries of about CHUNK that keep each context of TOP bytes whole."""
    cuts = np.flatnonzero(near[1:] != near[:-1]) + 1
    out, a = [], 0
    while a < len(near):
        k = int(np.searchsorted(cuts, a + CHUNK, "right")) - 1
        z = int(cuts[k]) if k >= 0 and cuts[k] > a else int(cuts[k + 1]) if k + 1 < len(cuts) else len(near)
        if len(near) - a <= CHUNK:
            z = len(near)
        out.append((a, z))
        a = z
    return out


class Root:
    """Depths 0 and 1 from the sums over their children: for each nearest byte and node the mixture below depth 1."""

    def __init__(self, rows: list[tuple[int, int, int, int, float]]):
        zeros, ones, kids = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
        for near, place, z, o, w in rows:
            zeros[near, place], ones[near, place], kids[near, place] = z, o, w
        kt = log_kt(zeros.ravel(), ones.ravel()).reshape(256, 256)
        weighted = halved(kt, kids)
        z0, o0 = zeros.sum(axis=0), ones.sum(axis=0)
        kt0 = log_kt(z0, o0)
        start = [np.full(256, 0.5), np.zeros(256), np.ones(256)]
        top = lowered(start, z0, o0, kt0, halved(kt0, weighted.sum(axis=0)))
        self.state = lowered(top, zeros, ones, kt, weighted)

    def below(self, keys: np.ndarray) -> list[np.ndarray]:
        """The state for nodes of depth 2: its key ends with the nearest byte, the byte before it, and the place."""
        near, place = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64)
        return [s[near, place] for s in self.state]


def _climbed(nodes: list[np.ndarray]) -> list[tuple]:
    """Nodes of depth TOP and upwards to depth 2."""
    levels = [(nodes[0], nodes[1], nodes[2], log_kt(nodes[1], nodes[2]), nodes[3], None)]
    for _ in range(TOP - 2):
        keys, zeros, ones, _, weighted, _ = levels[-1]
        levels.append(raised(keys, zeros, ones, weighted))
    return levels


def first_sums(nodes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of nodes of depth TOP that hold whole contexts of two bytes: nearest byte, place, zeros, ones and the children's log probability at depth 1."""
    keys, zeros, ones, _, weighted, _ = _climbed(nodes)[-1]
    up, parent = grouped(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(0xFF))
    z, o = (np.bincount(parent, n, len(up)).astype(np.int64) for n in (zeros, ones))
    return (up >> np.uint64(8)).astype(np.int32), (up & np.uint64(0xFF)).astype(np.int32), z, o, np.bincount(parent, weighted, len(up))


def mixture(nodes: list[np.ndarray], root: Root) -> list[np.ndarray]:
    """The state below each given node of depth TOP."""
    levels = _climbed(nodes)
    state = root.below(levels[-1][0])
    for i in range(len(levels) - 1, -1, -1):
        _, zeros, ones, kt, weighted, _ = levels[i]
        if i < len(levels) - 1:
            state = [s[levels[i + 1][5]] for s in state]
        state = lowered(state, zeros, ones, kt, weighted)
    return state


def _bundle(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where nodes of depth TOP meet: by their nearest two bytes."""
    near = keys >> np.uint64(8 * (TOP - 1))
    return (mix64(near) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def _words_dealt(words: pa.Array, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """As ``_dealt``, for words by their hash; those of one part are in order, which packs better."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    sorted_ = pc.sort_indices(words).to_numpy()
    order, cuts = _dealt(part[sorted_])
    return sorted_[order], cuts


def _range(near: np.ndarray, bits: int) -> np.ndarray:
    """The range of contexts: by their nearest TOP bytes."""
    return (mix64(near.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(near), np.int32)


def _dealt(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places in the order of their part, and (part, from, to) of each part that is there."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    own = part[order]
    cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)])) if len(own) else np.zeros(1, int)
    return order, [(int(own[a]), a, z) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def score_texts(texts: list[str | None], train: np.ndarray) -> np.ndarray:
    """The whole model on one machine: log10 of each text. For tests and small tables."""
    stream = Stream(*split_words(pa.array(texts, pa.string())))
    parts = list(stream.parts())
    train = np.asarray(train, bool)
    trees = [Subtree(e.near, e.far, e.byte, e.sums(train[doc])) for e, doc in parts]
    nodes = [np.concatenate(n) for n in zip(*[t.tops() for t in trees], strict=True)]
    order = np.argsort(nodes[0])
    nodes = [n[order] for n in nodes]
    root = Root(list(zip(*[x.tolist() for x in first_sums(nodes)], strict=True)))
    state = mixture(nodes, root)
    return sum(np.bincount(doc[e.order], e.spread(t.log10(nodes[0], state)), len(texts)) for t, (e, doc) in zip(trees, parts, strict=True))


_COLUMNS = ("block", "kind", "part", "vocabulary", "docs", "ids", "held", "lengths", "words", "counts", "entries", "trained")


def _blocks(df: DataFrame, key: str, text: str, held: str, word_bits: int, bits: int) -> DataFrame:
    """Rows of blocks. Kind 0: the documents (ids, folds, words as numbers of the block's vocabulary). Kind 1: the words of one hash range with training counts. Kind 2: the entries of one range of contexts with training counts."""
    id_type = df.schema[key].dataType.simpleString()
    schema = f"block bigint, kind int, part int, vocabulary binary, docs binary, ids array<{id_type}>, held array<boolean>, lengths array<int>, words binary, counts binary, entries binary, trained binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = counter(TaskContext.get().partitionId() << 32)
        for b in gathered(batches, text, BLOCK_BYTES):
            block = next(numbers)
            flat, lengths = split_words(b.column(text))
            coded = flat.dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            vocabulary = coded.dictionary.cast(pa.binary())
            by_word = pc.sort_indices(vocabulary).to_numpy()
            order = by_word[np.argsort(-np.bincount(of, minlength=len(vocabulary))[by_word], kind="stable")]  # frequent words have small numbers
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            of, vocabulary = number[of], vocabulary.take(pa.array(order))
            trains = ~b.column(held).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(of[np.repeat(trains, lengths)], minlength=len(vocabulary)).astype(np.uint32)
            order, cuts = _words_dealt(vocabulary, word_bits)
            rows = [(1, p, _pack_words(vocabulary.take(pa.array(order[a:z])).to_pylist()), _pack(counts[order[a:z]]), None, None) for p, a, z in cuts]
            parts = [(e.near, e.far, e.byte, e.sums(trains[doc]).astype(np.uint32)) for e, doc in Stream(flat, lengths).parts()]
            near, far, byte, trained = (np.concatenate(p) for p in zip(*parts, strict=True))
            del parts
            order, cuts = _dealt(_range(near, bits))
            for p, a, z in cuts:
                own = order[a:z]
                rows.append((2, p, None, None, _pack(near[own], far[own], byte[own]), _pack(trained[own])))
            del near, far, byte, trained
            k, n = len(rows) + 1, b.num_rows
            ends, none = pa.array([0] + [n] * k, pa.int32()), [None] * len(rows)
            cols = [
                pa.array([block] * k, pa.int64()), pa.array([0] + [r[0] for r in rows], pa.int32()), pa.array([-1] + [r[1] for r in rows], pa.int32()),
                pa.array([_pack_words(vocabulary.to_pylist()), *none], pa.binary()), pa.array([_pack(of), *none], pa.binary()),
                pa.ListArray.from_arrays(ends, b.column(key)), pa.ListArray.from_arrays(ends, b.column(held)), pa.ListArray.from_arrays(ends, pa.array(lengths, pa.int32())),
                *[pa.array([None] + [r[i] for r in rows], pa.binary()) for i in range(2, 6)],
            ]
            yield pa.RecordBatch.from_arrays(cols, names=list(_COLUMNS))
        tidy()

    return df.mapInArrow(run, schema)


def _counted(group: pa.Table) -> pa.Table:
    """Of a range of words: the training count of each block's words, and (in one row) how many tokens and distinct words the range has."""
    lists = [_unpack_words(w) for w in group.column("words").to_pylist()]
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    (each,), _ = _joined(group.column("counts").to_pylist(), np.uint32)
    counts = np.bincount(of, each, len(coded.dictionary)).astype(np.int64)
    ends = np.cumsum([len(x) for x in lists])
    none = [0] * (len(lists) - 1)
    return pa.table({
        "block": group.column("block"), "kind": pa.array([1] * len(lists), pa.int32()), "part": group.column("part"), "n": pa.array([0] * len(lists), pa.int64()),
        "figures": pa.array([_pack(counts[of[z - len(x) : z]]) for x, z in zip(lists, ends.tolist(), strict=True)], pa.binary()),
        "total": pa.array([int(counts.sum()), *none], pa.int64()), "distinct": pa.array([int(np.count_nonzero(counts)), *none], pa.int64()),
    })


def _merged(group: pa.Table) -> tuple[Entries, np.ndarray, np.ndarray]:
    (near, far, byte), sizes = _joined(group.column("entries").to_pylist(), np.uint32, np.uint32, np.uint8)
    e = Entries(near, far, byte)
    (n,), _ = _joined(group.column("trained").to_pylist(), np.uint32)
    return e, e.sums(n), sizes


def _tops(bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """Of a range of contexts: the nodes of depth TOP, packed for each bundle."""
        e, counts, _ = _merged(group)
        parts = [Subtree(e.near[a:z], e.far[a:z], e.byte[a:z], counts[a:z]).tops() for a, z in chunks(e.near)]
        keys, zeros, ones, weighted = (np.concatenate(p) for p in zip(*parts, strict=True))
        order, cuts = _dealt(_bundle(keys >> np.uint64(8), bits))
        cols = [c[order] for c in (keys, zeros, ones, weighted)]
        tidy()
        return pa.table({"bundle": pa.array([p for p, _, _ in cuts], pa.int32()), "part": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "nodes": pa.array([_pack(*[c[a:z] for c in cols]) for _, a, z in cuts], pa.binary())})

    return run


def _nodes(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    return _joined(group.column("nodes").to_pylist(), np.uint64, np.int64, np.int64, np.float64)


def _first_sums(group: pa.Table) -> pa.Table:
    nodes, _ = _nodes(group)
    return pa.table(dict(zip(("near", "place", "zeros", "ones", "kids"), map(pa.array, first_sums(nodes)), strict=True)))


def _mixtures(root: Root):
    def run(group: pa.Table) -> pa.Table:
        """Of a bundle: the state below its nodes, for the range that each came from."""
        nodes, sizes = _nodes(group)
        state, ends = mixture(nodes, root), np.cumsum(sizes)
        packed = [_pack(nodes[0][z - n : z], *[s[z - n : z] for s in state]) for n, z in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.table({"part": group.column("part"), "upper": pa.array(packed, pa.binary())})

    return run


def _scored(group: pa.Table, upper: pa.Table) -> pa.Table:
    """Of a range of contexts: log10 of each entry's byte, packed in the order that each block sent them."""
    if not group.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "figures": pa.array([], pa.binary())})
    e, counts, sizes = _merged(group)
    (keys, *state), _ = _joined(upper.column("upper").to_pylist(), np.uint64, np.float64, np.float64, np.float64)
    order = np.argsort(keys)
    keys, state = keys[order], [s[order] for s in state]
    value = np.concatenate([Subtree(e.near[a:z], e.far[a:z], e.byte[a:z], counts[a:z]).log10(keys, state) for a, z in chunks(e.near)])
    value, ends = e.back(_rounded(value)), np.cumsum(sizes)
    packed = pa.array([_pack(value[z - n : z]) for n, z in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())
    tidy()
    return pa.table({"block": group.column("block"), "kind": pa.array([2] * len(sizes), pa.int32()), "part": group.column("part"), "n": pa.array(sizes, pa.int64()), "figures": packed})


def _doc_scores(total: int, distinct: int, ends: int, word_bits: int, bits: int):
    base_of = math.log10(total + distinct + 1)

    def run(docs: pa.Table, figures: pa.Table) -> pa.Table:
        cols: dict = {n: [] for n in ("key", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score")}
        for r in docs.slice(0, 1).select(["vocabulary", "docs", "held", "lengths"]).to_pylist():
            words, (of,), lengths = pa.array(_unpack_words(r["vocabulary"]), pa.binary()), _unpack(r["docs"], np.uint32), np.array(r["lengths"], np.int64)
            known = np.zeros(len(words), np.int64)
            of_words = figures.filter(pc.equal(figures.column("kind"), 1)).sort_by("part")
            if len(words):
                known[_words_dealt(words, word_bits)[0]] = _joined(of_words.column("figures").to_pylist(), np.int64)[0][0]
            of_doc = np.repeat(np.arange(len(lengths)), lengths)
            cols["key"], cols["held_out"] = docs.column("ids").combine_chunks().flatten(), pa.array(r["held"], pa.bool_())
            cols["n_tokens"] = lengths + 1
            cols["n_known"] = np.bincount(of_doc, (known > 0)[of], len(lengths)).astype(np.int64) + (ends > 0)
            cols["base_score"] = np.bincount(of_doc, np.log10(known + 1)[of], len(lengths)) + math.log10(ends + 1) - (lengths + 1) * base_of
            del of_doc
            stream = Stream(words.cast(pa.string()).take(pa.array(of)), lengths)
            values = figures.filter(pc.equal(figures.column("kind"), 2)).sort_by("part")
            value = np.concatenate([_unpack(v, np.float32)[0] for v in values.column("figures").to_pylist()])
            # in the order of the ranges; each part of the stream takes its own share of every range
            begin = np.concatenate(([0], np.cumsum(values.column("n").to_numpy())))[:-1]
            begin = dict(zip(values.column("part").to_pylist(), begin.tolist(), strict=True))
            score = np.zeros(len(lengths))
            for e, doc in stream.parts():
                order, cuts = _dealt(_range(e.near, bits))
                own = np.empty(len(order))
                for p, a, z in cuts:
                    own[order[a:z]] = value[begin[p] : begin[p] + z - a]
                    begin[p] += z - a
                score += np.bincount(doc[e.order], e.spread(own), len(lengths))
            cols["score"], cols["n_bytes"] = score, stream.size
        n = len(cols["n_tokens"])
        tidy()
        return pa.table({
            "key": cols["key"] if n else docs.column("ids").combine_chunks().flatten(), "held_out": pa.array(cols["held_out"], pa.bool_()), "n_tokens": pa.array(cols["n_tokens"], pa.int64()), "n_known": pa.array(cols["n_known"], pa.int64()),
            "train_tokens": pa.array([total] * n, pa.int64()), "n_bytes": pa.array(cols["n_bytes"], pa.int64()), "base_score": pa.array(cols["base_score"], pa.float64()), "score": pa.array(cols["score"], pa.float64()),
        })

    return run


def score_documents(df: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row; ``held_out`` is the condition that keeps a row from training.

    n_bytes counts the bytes that are scored: the words, a blank after each, the end.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    word_bits = int(size / 45 / RANGE_WORDS).bit_length()  # some 45 bytes of text for each distinct word of a block
    bits = int(size / 4 / RANGE_ENTRIES).bit_length()  # some 4 for each distinct entry
    bundles = min(16, max(0, bits - 1))  # there are no more contexts of two bytes
    coded = stored(_blocks(rows, "key", "text", "held", word_bits, bits), "blocks")
    docs = coded.where("kind = 0").select("block", "vocabulary", "docs", "ids", "held", "lengths")
    contexts = coded.where("kind = 2").select("part", "block", "entries", "trained")
    counted = stored(coded.where("kind = 1").select("part", "block", "words", "counts").groupBy("part").applyInArrow(_counted, "block bigint, kind int, part int, n bigint, figures binary, total bigint, distinct bigint"), "counts")
    ends = docs.select(F.sum(F.size(F.filter("held", lambda x: ~x))).alias("n")).first()["n"] or 0
    found = counted.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    total, distinct = (found["n"] or 0) + ends, (found["v"] or 0) + (ends > 0)
    nodes = stored(contexts.groupBy("part").applyInArrow(_tops(bundles), "bundle int, part int, nodes binary"), "nodes")
    sums = nodes.groupBy("bundle").applyInArrow(_first_sums, "near int, place int, zeros bigint, ones bigint, kids double")
    root = Root([tuple(r) for r in sums.groupBy("near", "place").agg(F.sum("zeros"), F.sum("ones"), F.sum("kids")).collect()])
    upper = nodes.groupBy("bundle").applyInArrow(_mixtures(root), "part int, upper binary")
    release(df.sparkSession)
    values = contexts.groupBy("part").cogroup(upper.groupBy("part")).applyInArrow(_scored, "block bigint, kind int, part int, n bigint, figures binary")
    figures = counted.select(*values.columns).unionByName(values)
    id_type = rows.schema["key"].dataType.simpleString()
    out = docs.groupBy("block").cogroup(figures.groupBy("block")).applyInArrow(_doc_scores(total, distinct, ends, word_bits, bits), f"key {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, n_bytes bigint, base_score double, score double")
    per_byte = (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", per_byte)


def document_scores(documents: DataFrame) -> DataFrame:
    return score_documents(documents, doc_fold("doc_id", 7) == 2)
