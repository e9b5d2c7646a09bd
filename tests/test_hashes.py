"""Hashes of many strings at once are those of hashlib."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docsluice.functions import hashes


@pytest.mark.parametrize("name", ["md5", "sha1"])
def test_digests_are_those_of_hashlib(monkeypatch, name):
    monkeypatch.setattr(hashes, "LANES", 64)
    r = random.Random(3)
    texts = ["", "a", "é_ñ", "x" * 55, "x" * 56, "ö" * 28, "y" * 200] + ["".join(r.choice("abcé漢_0") for _ in range(r.randint(0, 40))) for _ in range(500)]
    strings = hashes.Strings(pa.array(texts)[0:])
    want = [np.frombuffer(getattr(hashlib, name)(t.encode()).digest(), ">u4").tolist() for t in texts]
    assert hashes.digests(name, strings).tolist() == want
    assert hashes.digests(name, hashes.Strings(pa.array(texts)[5:9])).tolist() == want[5:9]
    assert hashes.digests(name, hashes.Strings(pa.array([], pa.string()))).shape == (0, len(want[0]))
    assert list(strings)[:2] == [b"", b"a"]


def test_a_text_of_pairs_hashes_none_of_them_by_itself(monkeypatch):
    """Before, each distinct word and pair of words was an object and a call."""
    from docsluice.operators import dense

    monkeypatch.setattr(hashes.hashlib, "sha1", None)
    ids, v = dense._made(pa.table({"chunk_id": ["c"], "words": ["radar power radar"]}), "chunk_id", 384)
    assert ids == ["c"] and (v * v).sum() == pytest.approx(1)
