"""Ranked lexical search: the best K documents of each query item, by WAND over document shards.

The documents of a task are cut into shards of SHARD documents. A shard's index holds, for each
term, the documents that hold it in rising order and how often they do; it is written once, and
the corpus counts (documents, terms, documents by term) are summed from it. A query term's
impact on a document is an integer that falls with the document's length; its maximum over a
shard bounds what the term can add there.

For each item a task walks its shards with one cursor a term and one heap of the K best. The
cursors are put in order of their documents; the pivot is the first one at which the summed
maxima reach the heap's least score. No document before the pivot's can enter, so the cursors
before it jump there; a document is scored when all cursors up to the pivot stand on it. Equal
scores can still win by their id, so a bound equal to the least score does not skip. The heap
and its threshold pass on from shard to shard. The tasks' heaps, K rows an item each, are then
merged in two steps, so that an item's rows of all tasks never meet in one place.

Items are a query set: their distinct terms decide what the index keeps (all terms, if there
are more than MOST_TERMS; results are the same), and they are searched in parts of about PART
items and PART_BYTES of text, one after the other over the stored index, not over the texts.

Defined results: a null or empty text and one without a term are never found and do not count
as documents; an item without a term or a hit has no rows; items with a null or repeated id are
searched one by one; a null doc_id comes last among equal scores; repeated rows are found each;
an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .resample import words_of

K = 10
SHARD = 2048
MOST_TERMS = 1_000_000
PART = 2_000
PART_BYTES = 8_000_000
#: Parameters of the score, as integers: a document's length counts 90 of 100, the saturation is 0.8 occurrences.
FLAT, STEEP, SATURATION = 10, 90, 8
_END = 1 << 31
_NO_ID = 1 << 64
INDEX = "term string, ids array<long>, docs array<int>, n array<int>"


def build_index(docs: DataFrame, terms: frozenset[bytes] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards as rows: one with the ids and lengths (n) of its documents and no term, then one a term with docs, places
    among these ids, and n, the term's occurrences there. terms: those to keep, or None for all."""

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, postings = [], [], defaultdict(lambda: ([], []))

        def rows() -> pd.DataFrame:
            out = [(None, ids, None, lengths), *((t.decode(), None, d, n) for t, (d, n) in postings.items())]
            return pd.DataFrame(out, columns=["term", "ids", "docs", "n"])

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                if words := words_of(text):
                    counts = Counter(words)
                    for term in counts if terms is None else counts.keys() & terms:
                        at, n = postings[term]
                        at.append(len(ids))
                        n.append(counts[term])
                    ids.append(None if pd.isna(doc_id) else int(doc_id))
                    lengths.append(len(words))
                if len(ids) == SHARD:
                    yield rows()
                    ids, lengths, postings = [], [], defaultdict(lambda: ([], []))
        if ids:
            yield rows()

    # long ids with nulls would come as floats
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(shards, INDEX))


def impacts(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of this weight adds to documents of length norm m that hold it tf times."""
    return weight * (1_000_000_000 * tf // (1000 * tf + SATURATION * m))


def wand(postings: list[tuple[list[int], list[int], int]], heap: list[tuple[int, int]], k: int, ids: list[int]) -> int:
    """Puts the shard's documents that belong to the best k into heap; the number of documents scored.

    postings: of each term the documents, ended by _END, its impacts, and their maximum. ids: by document, what
    orders equal scores, lowest first. heap: (score, -id).
    """
    docs, impact, most = zip(*postings)
    at, now, order, scored = [0] * len(docs), [d[0] for d in docs], list(range(len(docs))), 0
    least = heap[0][0] if len(heap) == k else 1
    while True:
        order.sort(key=now.__getitem__)
        bound = 0
        for term in order:
            bound += most[term]
            if bound >= least:
                break
        else:
            return scored
        pivot = now[term]
        if pivot == _END:
            return scored
        if now[order[0]] < pivot:
            for term in order:
                if now[term] >= pivot:
                    break
                at[term] = p = bisect_left(docs[term], pivot, at[term] + 1)
                now[term] = docs[term][p]
            continue
        score = 0
        for term in order:
            if now[term] != pivot:
                break
            p = at[term]
            score += impact[term][p]
            at[term], now[term] = p + 1, docs[term][p + 1]
        scored += 1
        if score >= least:
            found = (score, -ids[pivot])
            if len(heap) < k:
                heappush(heap, found)
            elif found > heap[0]:
                heapreplace(heap, found)
            if len(heap) == k:
                least = heap[0][0]


def _searched(items: dict[int, list[str]], weights: dict[str, int], documents: int, length: int, k: int):
    """A task's heaps for items (terms by number)."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[int, int]]] = {i: [] for i in items}
        ids: list[int] = []
        m, shard = np.zeros(0, np.int64), {}

        def walk() -> None:
            for i, terms in items.items():
                if own := [shard[t] for t in terms if t in shard]:
                    wand(own, heaps[i], k, ids)

        for frame in frames:
            for term, own_ids, docs, n in zip(frame["term"], frame["ids"], frame["docs"], frame["n"], strict=True):
                if term is None:
                    walk()
                    ids = [_NO_ID if pd.isna(x) else int(x) for x in own_ids]
                    m, shard = FLAT + STEEP * np.asarray(n, np.int64) * documents // length, {}
                elif weights.get(term, 0) > 0:
                    adds = impacts(weights[term], np.asarray(n, np.int64), m[docs])
                    shard[term] = ([*docs.tolist(), _END], adds.tolist(), int(adds.max()))
        walk()
        out = [(i, None if d == -_NO_ID else -d, s) for i, heap in heaps.items() for s, d in heap]
        yield pd.DataFrame(out, columns=["number", "doc_id", "score"]).astype({"number": "int64", "doc_id": "Int64", "score": "int64"})

    return search


def best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows by key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above zero."""
    items = materialize(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")))
    split = F.pandas_udf(lambda texts: pd.Series([[w.decode() for w in dict.fromkeys(words_of(t))] for t in texts]), "array<string>")
    asked = materialize(items.select("number", split("text").alias("terms")))
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    some = terms.limit(MOST_TERMS + 1).collect()
    index = build_index(docs, frozenset(r.term.encode() for r in some) if len(some) <= MOST_TERMS else None, id_col, text_col)
    shards = index.filter(F.col("term").isNull()).agg(F.sum(F.size("ids")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)))
    documents, length = (x or 0 for x in shards.first())
    if not documents:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    df = materialize(index.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("docs")).alias("df")).join(terms, "term"))
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil(n / PART), math.ceil((size or 0) / PART_BYTES))
    found = []
    for p in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == p)
        own = {r.number: r.terms for r in part.collect()}
        held = part.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()
        weights = {r.term: math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))) for r in held}
        rows = index.mapInPandas(_searched(own, weights, documents, length, k), "number long, doc_id long, score long")
        # tasks of about the same root meet first: about as many groups as each has members
        rows = best(rows.withColumn("group", F.floor(F.sqrt(F.spark_partition_id()))), ["number", "group"], k)
        found.append(materialize(best(rows, ["number"], k)))
    return reduce(DataFrame.unionByName, found).join(items, "number").select("item_id", "rank", "doc_id", "score")
