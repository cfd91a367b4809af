"""Suffix arrays and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ripplecast.llm import queries, suffixes

from ..conftest import SF
from .data import SCHEMA, documents, prose, rows


def plain(docs, length):
    bodies = [(t or "").encode() for _, t in docs]
    windows = Counter(hashlib.md5(b[i : i + length]).digest() for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(docs, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if windows[hashlib.md5(b[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_suffix_arrays():
    for seed in range(2000):
        rng = random.Random(seed)
        s = [rng.randrange(1, 2 + rng.randrange(1, 6)) for _ in range(rng.randrange(50))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([1] * 500 + [0], [1, 2] * 300 + [0], [*range(400, -1, -1)]):
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("length", "gram", "cell"), [(200, 64, 16), (12, 4, 3), (20, 20, 8)])
def test_odd_rows(spark, length, gram, cell):
    """Null, empty and very long texts, texts of one letter, repeated rows, null ids, other columns."""
    docs = [r[:2] for r in rows() if len(r[1] or "") < 100_000]
    some = [r for r in rows() if len(r[1] or "") < 100_000]
    got = suffixes.deduplicated(documents(spark, some), length, gram, cell)
    assert Counter(map(tuple, got.collect())) == plain(docs, length)
    assert suffixes.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("block", "slices"), [(2048, 1 << 20), (4, 150)])
def test_shared_passages(spark, monkeypatch, block, slices):
    """Many texts around shared passages and edited copies; anchors of many contexts and texts in slices change nothing."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "SLICE", slices)
    rng = random.Random(11)
    passages = [prose(100 + i, 30) for i in range(4)]
    base = prose(50, 90)
    texts = []
    for i in range(120):
        if i % 3:
            texts.append(prose(200 + i, rng.randrange(12)) + " " + rng.choice(passages)[rng.randrange(9) :] + " " + prose(400 + i, rng.randrange(12)))
        else:
            words = base.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"edit{i}"
            texts.append(" ".join(words))
    texts += ["ab" * 150, "ab" * 90 + "c" + "ab" * 120, passages[0] * 2]
    docs = [(i, t, None, None, None, 1, 2, "x", "y") for i, t in enumerate(texts)]
    for length, gram, cell in ((60, 16, 8), (25, 8, 5)):
        got = suffixes.deduplicated(documents(spark, docs), length, gram, cell)
        assert Counter(map(tuple, got.collect())) == plain([d[:2] for d in docs], length)


def test_equal_hashes_are_compared():
    """Windows that only hash alike are told apart."""

    class Flat(suffixes.Powers):
        def sums(self, data):
            return np.zeros(len(data) + 1, np.uint64)

    texts = [b"0123456789abcdefX" + b"k" * 14, b"0123456789abcdefX" + b"k" * 14, b"0123456789abcdefY" + b"k" * 14]
    want = suffixes.repeated(texts, [2, 2, 2], suffixes.Powers(1000), 20, 4)
    got = suffixes.repeated(texts, [2, 2, 2], Flat(1000), 20, 4)
    assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, want.tolist()))
    assert {i for i, s in want.tolist() if s == 0} == {0, 1}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.op13_suffixes(spark, SF).collect())) == plain(docs, 200)
