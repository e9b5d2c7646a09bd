"""Packing of token pieces into sequences: best fit in order of arrival, then swap-based local search.

Pieces are dealt at random into groups of bounded size. A group starts from a
plain packing (each piece as it comes into the fullest open bin that takes it),
and local search then empties bins: an underfull bin gives one piece or two for
none, one or two of any fuller bin, which raises the sum of squared fills; a bin
that empties goes. It ends where the lower bound is met or full passes over all
underfull bins empty none; above the bound it is run again from a start of the
longest first. Bins that stay below OPEN_SHARE return to a pool that is packed
again as long as that takes fewer groups, so all groups together waste about
what one would.

Defined cases: null text is empty and is one piece, the closing id alone.
Repeated rows are pieces of their own. An empty table gives no row. Only the id
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, modest, stored, worked
from .tokens import END_ID, SLICE, WordTokenizer, default_path

CAPACITY = 4096
GROUP_PIECES = 16_384
OPEN_SHARE = 0.985
STAGE_SLICE = 2 << 20  # in the pipeline, whose earlier stages leave executors little memory


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, most: int = SLICE) -> DataFrame:
    """One row for each piece: key, uid, piece, start, length, ids_crc32. A longer document is cut every ``capacity`` ids. ``most``: bytes of text that a worker encodes at once."""
    path = path or default_path()
    id_type = df.schema[key].dataType.simpleString()
    close = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.at(path)
        number = TaskContext.get().partitionId() << 36

        def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, lengths = tok.encode(b.column(text))
            data, at, rows = memoryview(ids.tobytes()), 0, []
            for d, n in enumerate(lengths.tolist()):
                whole = bytes(data[4 * at : 4 * (at + n)]) + close
                at += n
                for p, s in enumerate(range(0, n + 1, capacity)):
                    part = whole[4 * s : 4 * (s + capacity)]
                    rows.append((d, number, p, s, len(part) // 4, zlib.crc32(part)))
                    number += 1
            of = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key).take(of[0]), *of[1:]], names=[key, "uid", "piece", "start", "length", "ids_crc32"])

        yield from worked(gathered(batches, text, most), cut)

    return df.select(key, text).mapInArrow(run, f"{key} {id_type}, uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of places in ``lengths``): each piece as it comes into the fullest open bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r free places
    for i, n in enumerate(lengths):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            same = by_room[room]
            b = same.pop()
            if not same:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            if not by_room.get(room):
                by_room[room] = []
                rooms |= 1 << room
            by_room[room].append(b)
    return bins


def _offers(members: list[int], lengths: list[int]) -> dict[int, tuple[int, ...]]:
    """One piece or two of a bin for each sum of lengths that they can have."""
    one = {lengths[i]: i for i in members}
    twice = {n: [i for i in members if lengths[i] == n][:2] for n in one} if len(one) < len(members) else {}
    out = {n + m: (i, j) for (n, i), (m, j) in itertools.combinations(one.items(), 2)}
    out.update({2 * n: tuple(x) for n, x in twice.items() if len(x) == 2})
    out.update({n: (i,) for n, i in one.items()})
    return out


class _Underfull:
    """What each underfull bin can give back (nothing, a piece, two), in flat arrays over all bins."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int, fill: dict[int, int]):
        self.bins, self.lengths, self.capacity, self.fill = bins, lengths, capacity, fill
        self.room = np.zeros(len(bins), np.int64)
        self.spans: dict[int, tuple[int, int]] = {}
        self.back: dict[int, list[tuple[int, ...]]] = {}
        self.sums, self.of, self.end = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        for b in fill:
            self.put(b)

    def put(self, b: int) -> None:
        """Take up bin ``b`` as it is now."""
        if b in self.spans:
            self.of[slice(*self.spans.pop(b))] = -1
        self.room[b] = self.capacity - self.fill[b] if b in self.fill else 0
        if not self.room[b]:
            return
        offers = {0: ()} | _offers(self.bins[b], self.lengths)
        n = len(offers)
        if self.end + n > len(self.sums):
            self._compact(n)
        self.spans[b], self.back[b] = (self.end, self.end + n), list(offers.values())
        self.sums[self.end : self.end + n], self.of[self.end : self.end + n] = list(offers), b
        self.end += n

    def _compact(self, n: int) -> None:
        live = np.flatnonzero(self.of[: self.end] >= 0)
        size = max(1 << 12, 2 * (len(live) + n))
        sums, of = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        sums[: len(live)], of[: len(live)] = self.sums[live], self.of[live]
        self.spans = {b: (int(np.searchsorted(live, a)), int(np.searchsorted(live, z))) for b, (a, z) in self.spans.items()}
        self.sums, self.of, self.end = sums, of, len(live)

    def give(self, giver: int, exact: bool) -> bool:
        """One exchange that moves pieces from ``giver`` into a bin at least as full; false if there is none.

        ``exact`` takes the one that leaves the taker the least room, which
        keeps wide rooms for the last pieces; otherwise the one that moves most.
        """
        of, sums = self.of[: self.end], self.sums[: self.end]
        most = np.where(self.room <= self.room[giver], self.room, 0)
        most[giver] = 0
        most = np.where(of >= 0, most[of], 0)
        seen = np.flatnonzero(most)
        if not len(seen):
            return False
        most, sums = most[seen], sums[seen]
        best, value, out, at = 0, -self.capacity, (), -1
        for n, x in sorted(_offers(self.bins[giver], self.lengths).items(), reverse=True):
            gain = n - sums
            worth = np.where((gain > 0) & (gain <= most), gain - most if exact else gain, -self.capacity)
            k = int(worth.argmax())
            if worth[k] > value:
                best, value, out, at = int(gain[k]), int(worth[k]), x, k
                if exact and value == 0:
                    break
        if not best:
            return False
        taker = int(of[seen[at]])
        back = self.back[taker][int(seen[at]) - self.spans[taker][0]]
        self.bins[giver] = [i for i in self.bins[giver] if i not in out] + list(back)
        self.bins[taker] = [i for i in self.bins[taker] if i not in back] + list(out)
        self.fill[giver] -= best
        self.fill[taker] += best
        self.put(taker)
        self.put(giver)
        return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins one after another until the lower bound is met or a pass of each kind over all underfull ones empties none."""
    least = -(-sum(lengths) // capacity)
    bins = [list(x) for x in bins]
    fill = {b: sum(lengths[i] for i in x) for b, x in enumerate(bins)}
    if len(fill) <= least:
        return bins
    state, idle, exact = _Underfull(bins, lengths, capacity, fill), 0, True
    while idle < 2 and len(fill) > least:
        idle += 1
        for giver in sorted((b for b in fill if fill[b] < capacity), key=lambda b: (fill[b], b)):
            while bins[giver] and state.give(giver, exact):
                pass
            if not bins[giver]:
                del fill[giver]
                state.put(giver)
                idle = 0
                if len(fill) <= least:
                    break
        exact = not exact
    return [bins[b] for b in fill]


def searched(lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search from the order of arrival; where that stays above the lower bound, also from longest first, and the better of both."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    if len(bins) > -(-sum(lengths) // capacity):
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        start = [[order[i] for i in x] for x in best_fit([lengths[i] for i in order], capacity)]
        bins = min(bins, local_search(start, lengths, capacity), key=len)
    return bins


def _packer(turn: int, capacity: int, last: bool):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        lengths = group.column("length").to_pylist()
        bins = searched(lengths, capacity)
        seq, off, done = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.ones(len(lengths), bool)
        base = turn << 56 | key[0].as_py() << 24
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = base | b, at
                at += lengths[i]
            if not last and at < OPEN_SHARE * capacity:
                done[members] = False
        return group.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).append_column("done", pa.array(done)).drop_columns(["deal"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to stored pieces (columns uid and length, any others)."""
    now, done, turn = cut, [], 0
    names, groups = cut.columns, None
    while True:
        before, groups = groups, max(1, -(-now.count() // group))
        last = groups == 1 or before is not None and groups >= before
        dealt = now.withColumn("deal", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).cast("int"))
        packed = stored(dealt.groupBy("deal").applyInArrow(_packer(turn, capacity, last), now.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).withColumn("done", F.lit(True)).schema), "packed")
        done.append(packed.where("done").select(*names, "sequence_id", "offset"))
        if last:
            break
        now, turn = packed.where("not done").select(*names), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def document_sequences(documents: DataFrame, capacity: int = CAPACITY, most: int = SLICE) -> DataFrame:
    cut = stored(pieces(documents, capacity=capacity, most=most), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of all documents that reach it."""
    modest(spark)
    return document_sequences(docs, most=STAGE_SLICE)
