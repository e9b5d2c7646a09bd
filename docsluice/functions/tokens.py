"""Words of texts in Arrow batches, from the bytes of characters below U+0100; texts with others bring theirs from ``functions.text``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

TEXT_BYTES = 1 << 19  # of texts that are read at once; a longer one goes by itself

_LATIN = [chr(i) for i in range(256)]
_LOWER = np.array([ord(c.lower()) for c in _LATIN], np.uint8)
_WORD = np.array([unicodedata.category(c)[0] in "LN" or c == "_" for c in _LATIN])
_TERM = _WORD | np.array([c in "$%" for c in _LATIN])
_DIGIT = np.array([unicodedata.category(c) == "Nd" for c in _LATIN])
_BETWEEN = np.array([c in "-./" for c in _LATIN])


def columns(text: Column, words: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The text (null: empty), or null if a character is above U+00FF; and then what ``words`` finds, between blanks."""
    plain = F.coalesce(text, F.lit(""))
    wide = F.rlike(plain, F.lit(r"[^\x00-\xFF]"))
    return F.when(~wide, plain).alias("text"), F.when(wide, F.array_join(words(plain), " ")).alias("words")


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character, lower case, a line feed after each text; and where those are."""
    n = len(texts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts), "\n")[0].as_buffer()
    raw = np.append(np.frombuffer(joined, np.uint8), np.uint8(10))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        raw[lead + 1] += ((raw[lead] & 1) << 6).astype(np.uint8)
        raw, ends = np.delete(raw, lead), ends - np.searchsorted(lead, ends)
    return _LOWER[raw], ends


def _runs(low: np.ndarray, kept: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The text of each run of kept characters, and the runs."""
    turns = np.flatnonzero(kept[1:] != kept[:-1]) + 1
    turns = np.append(0, turns) if kept[0] else turns
    starts, stops = turns[::2], turns[1::2]  # no text ends with a kept character
    data, offsets = low[kept], np.concatenate(([0], np.cumsum(stops - starts)))
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        at, values, wide = high + np.arange(len(high)), data[high], data >= 0x80
        offsets = offsets + np.append(0, np.cumsum(wide))[offsets]
        data = np.repeat(data, 1 + wide)
        data[at], data[at + 1] = 0xC2 + (values >> 6 & 1), 0x80 | values & 0x3F
    return np.searchsorted(ends, starts), pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``text.word_tokens``"""
    low, ends = _characters(texts)
    return _runs(low, _WORD[low], ends)


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``text.bm25_runs``"""
    low, ends = _characters(texts)
    comma = np.flatnonzero(low == 44)
    comma = comma[(comma > 0) & _DIGIT[low[comma - 1]] & _DIGIT[low[np.minimum(comma + 1, len(low) - 1)]]]
    if len(comma):
        low, ends = np.delete(low, comma), ends - np.searchsorted(comma, ends)
    kept = _TERM[low]
    kept[1:-1] |= _BETWEEN[low[1:-1]] & kept[:-2] & kept[2:]
    return _runs(low, kept, ends)


def _pieces(texts: pa.Array) -> Iterator[slice]:
    sizes, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TEXT_BYTES, "right")))
        yield slice(start, stop)
        start = stop


def _of(texts: pa.Array, words: pa.Array, find) -> tuple[np.ndarray, pa.Array]:
    """The text of each word, in order, and the words, as one array; ``texts`` and ``words`` as of ``columns``."""
    plain, rows, found = pc.fill_null(texts, ""), [np.empty(0, np.int64)], [pa.array([], pa.string())]
    for part in _pieces(plain):
        row, each = find(plain[part])
        rows.append(row + part.start)
        found.append(each)
    wide = np.flatnonzero(texts.is_null().to_numpy(zero_copy_only=False))
    if len(wide):
        lists = pc.split_pattern(pc.fill_null(words.take(pa.array(wide)), ""), " ")
        row, each = np.repeat(wide, pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
        real = pc.not_equal(each, "")
        rows.append(row[real.to_numpy(zero_copy_only=False)])
        found.append(each.filter(real))
    row, each = np.concatenate(rows), pa.concat_arrays(found)
    if not len(wide):
        return row, each
    order = np.argsort(row, kind="stable")
    return row[order], each.take(pa.array(order))


def terms(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``text.bm25_runs`` of each text."""
    return _of(texts, words, _terms)


def content(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """``text.content_words`` of each text, from ``columns`` with ``text.word_tokens``."""
    row, each = _of(texts, words, _words)
    coded = each.dictionary_encode()
    said = pc.invert(pc.is_in(coded.dictionary, pa.array(T.STOPWORDS))).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    only = np.bincount(row[said], minlength=len(texts)) == 0  # of stopwords alone
    kept = np.flatnonzero(said | only[row])
    return row[kept], coded.take(pa.array(kept))
