"""Importance resampling against a plain computation and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ripplecast.llm import oracle, queries, resample

from ..conftest import SF
from .data import SCHEMA, documents, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TARGET = [(1, "alpha bravo charlie3 漢字 漢字"), (2, None), (3, "Papa QUEBEC romeo papa quebec"), (4, "")]


def features(text, order):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, order=1, buckets=10_000, percent=10, least=20):
    own = [features(t, order) for _, t in docs]
    raw = Counter(c % buckets for _, f in own for c in f)
    aim = Counter(c % buckets for _, t in target for c in features(t, order)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for (d, _), (n, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in f)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(may[: len(may) * percent // 100]):
        r[5] = i + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("order", "nodes", "step"), [(1, 400_000, 65_536), (3, 400_000, 65_536), (2, 50, 7)])
def test_as_computed_plainly(spark, monkeypatch, order, nodes, step):
    """Null, empty and very long texts, repeated rows and null ids; tries that are emptied and long texts in parts change nothing."""
    monkeypatch.setattr(resample, "MOST_NODES", nodes)
    monkeypatch.setattr(resample, "_STEP", step)
    docs = [r[:2] for r in rows()]
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = resample.drawn(documents(spark), target, percent=40, order=order, buckets=97)
    assert Counter(map(tuple, got.collect())) == plain(docs, TARGET, order, 97, 40)


def test_ties_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    same = documents(spark, [(i, "one two three " * 10, None, None, None, 1, 2, "x", "y") for i in (7, 3, 3, None, 5)])
    assert resample.drawn(none, none).count() == 0
    got = resample.drawn(same, none, percent=60)
    assert Counter(map(tuple, got.collect())) == plain([(i, "one two three " * 10) for i in (7, 3, 3, None, 5)], [], percent=60)


def test_query_as_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(oracle.RESAMPLE)
    columns = [d[0] for d in want.description]
    got = queries.op12_resample(spark, SF).select(columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
