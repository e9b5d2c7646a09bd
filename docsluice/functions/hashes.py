"""MD5 and SHA-1 of many short strings at once: each step of a hash is one operation on all of them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LANES = 1 << 14  # strings of a run, so that it stays in the cache
SHORT = 55  # bytes of one block; longer strings go to hashlib

_U = [np.uint32(i) for i in range(33)]
_SHA1_K = [np.uint32(k) for k in (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)]
_SHA1_H = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
_MD5_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_AT = ((1, 0), (5, 1), (3, 5), (7, 0))


class Strings:
    """Strings in Arrow; by themselves their bytes."""

    def __init__(self, array: pa.Array):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.array.cast(pa.binary()).to_pylist())


def _turned(x: np.ndarray, by: int, out: np.ndarray, t: np.ndarray) -> np.ndarray:
    np.left_shift(x, _U[by], out=out)
    np.right_shift(x, _U[32 - by], out=t)
    return np.bitwise_or(out, t, out=out)


def _sha1(w: np.ndarray) -> list[np.ndarray]:
    """w: the 16 words of each block, as rows."""
    n = w.shape[1]
    a, b, c, d, e = (np.full(n, h, np.uint32) for h in _SHA1_H)
    f, s, t = (np.empty(n, np.uint32) for _ in range(3))
    for i in range(80):
        x = w[i & 15]
        if i >= 16:
            x ^= w[(i - 3) & 15]
            x ^= w[(i - 8) & 15]
            x ^= w[(i - 14) & 15]
            _turned(x, 1, s, t)
            x[:] = s
        if i < 20:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif 40 <= i < 60:
            np.bitwise_xor(b, c, out=f)
            f &= d
            np.bitwise_and(b, c, out=s)
            f ^= s
        else:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        e += f
        e += _SHA1_K[i // 20]
        e += x
        e += _turned(a, 5, s, t)
        _turned(b, 30, s, t)
        a, b, c, d, e, s = e, a, s, c, d, b  # b's array is free now
    return [x + np.uint32(h) for x, h in zip((a, b, c, d, e), _SHA1_H, strict=True)]


def _md5(w: np.ndarray) -> list[np.ndarray]:
    n = w.shape[1]
    a, b, c, d = (np.full(n, h, np.uint32) for h in _SHA1_H[:4])
    s, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        r = i // 16
        if r == 0:
            np.bitwise_xor(c, d, out=s)
            s &= b
            s ^= d
        elif r == 1:
            np.bitwise_xor(b, c, out=s)
            s &= d
            s ^= c
        elif r == 2:
            np.bitwise_xor(b, c, out=s)
            s ^= d
        else:
            np.bitwise_not(d, out=s)
            s |= b
            s ^= c
        a += s
        a += _MD5_K[i]
        a += w[(_MD5_AT[r][0] * i + _MD5_AT[r][1]) % 16]
        _turned(a, _MD5_TURN[r][i % 4], s, t)
        s += b
        a, b, c, d, s = d, s, b, c, a
    return [(x + np.uint32(h)).byteswap() for x, h in zip((a, b, c, d), _SHA1_H[:4], strict=True)]


def _blocks(texts: pa.Array, order: str) -> np.ndarray:
    """The 16 words of the one block of each string."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts), "")[0].as_buffer(), np.uint8)
    block = np.zeros((n, 64), np.uint8)
    block.reshape(-1)[np.arange(len(data)) + np.repeat(np.arange(n) * 64 - (np.cumsum(size) - size), size)] = data
    block[np.arange(n), size] = 0x80
    words = np.ascontiguousarray(block.view(f"{order}u4").T).astype(np.uint32)
    words[15 if order == ">" else 14] = size * 8
    return words


def digests(name: str, strings: Strings) -> np.ndarray:
    """Digests (``md5`` or ``sha1``) as rows of 32-bit numbers, the highest first."""
    make, run, order, width = {"md5": (hashlib.md5, _md5, "<", 4), "sha1": (hashlib.sha1, _sha1, ">", 5)}[name]
    texts = strings.array
    out = np.empty((width, len(texts)), np.int64)
    long = pc.greater(pc.binary_length(texts), SHORT).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(~long)
    for at in range(0, len(short), LANES):
        some = short[at : at + LANES]
        out[:, some] = run(_blocks(texts.take(pa.array(some)), order))
    for i in np.flatnonzero(long):
        out[:, i] = np.frombuffer(make(texts[i].as_py().encode()).digest(), ">u4")
    return out.T
