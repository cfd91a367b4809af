"""Ranked search against a plain computation and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from ripplecast.llm import oracle, queries, search

from ..conftest import SF
from .data import SCHEMA, documents, rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = [(1, "alpha bravo ALPHA kilo3 mike"), (2, None), (2, "tango, tango! sierra"), (None, "omega 漢字 ünïcode"), (4, " .. "), (5, "nowhere"), (6, "two words one a b c")]


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k):
    own = [(d, Counter(terms_of(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, size, df = len(own), sum(c.total() for _, c in own), Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms_of(text)) if df[t]}
        found = []
        for d, c in own:
            m = 10 + 90 * c.total() * n // size
            found.append((sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked.items() if c[t]), d))
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(found[:k])]
    return Counter(out)


@pytest.mark.parametrize(("k", "shard", "most", "part"), [(10, 2048, 1_000_000, 2_000), (3, 2, 1_000_000, 2_000), (2, 3, 0, 2), (1, 1, 0, 2_000)])
def test_as_computed_plainly(spark, monkeypatch, k, shard, most, part):
    """Odd rows, shards of few documents, an index of all terms, items in parts."""
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "MOST_TERMS", most)
    monkeypatch.setattr(search, "PART", part)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = search.ranked(documents(spark), items, k)
    assert Counter(map(tuple, got.collect())) == plain([r[:2] for r in rows()], ITEMS, k)


def test_equal_scores_and_empty_tables(spark):
    same = [(i, "one two three", None, None, None, 1, 2, "x", "y") for i in (9, 4, None, 7, 4)] + [(i, "four", None, None, None, 1, 2, "x", "y") for i in range(20, 40)]
    items = [(1, "two three four"), (2, "four")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, search.ranked(documents(spark, same), asked, 3).collect())) == plain([r[:2] for r in same], items, 3)
    none = spark.createDataFrame([], SCHEMA)
    assert search.ranked(none, asked).count() == search.ranked(documents(spark), asked.limit(0)).count() == 0
    assert search.ranked(none, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_wand_skips_and_loses_nothing():
    """Random postings: the heap is that of all documents, and fewer than all are scored."""
    rng = random.Random(5)
    scored = 0
    for _ in range(60):
        ids = rng.sample(range(10_000), 400)
        lists, total = [], Counter()
        for t in range(rng.randrange(1, 9)):
            docs = sorted(rng.sample(range(400), rng.randrange(1, 300)))
            adds = [rng.randrange(1, 5 + 30 * t) for _ in docs]
            total.update(dict(zip(docs, adds, strict=True)))
            lists.append(([*docs, search._END], adds, max(adds)))
        heap = []
        scored += search.wand(lists, heap, 10, ids)
        assert sorted(heap, reverse=True) == sorted(((s, -ids[d]) for d, s in total.items()), reverse=True)[:10]
    assert scored < 60 * 400 / 2


def test_query_as_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(oracle.SEARCH)
    got = queries.op11_search(spark, SF).select([d[0] for d in want.description])
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
