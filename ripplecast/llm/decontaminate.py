"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

An item is a benchmark text of n words; a document is contaminated by it if one of its windows
of n words has a weighted Jaccard similarity of at least SIMILARITY with the item, over
shingles of SHINGLE words (a shingle's weight is how often it occurs; texts with fewer words
are one shingle). A document with fewer words than the item is one window by itself. Words are
runs of other characters than ASCII white space, A-Z in lower case.

* Only windows that hold at least one shingle of some item of their size can be similar, so
  the others are passed over; this loses nothing.
* Each remaining window gets a SimHash of BITS bits from running sums over its shingles' bits.
* The index cuts fingerprints into BLOCKS blocks of 16 bits and lists an item under all values
  within NEAR bits of its own. Fingerprints that differ in less than BLOCKS * (NEAR + 1) bits
  (36) have such a block, so none of them is missed. At similarity 0.8 a window and an item
  differ in 29 of the 192 bits on the average, with a deviation of 5; of those beyond 35 a
  block within NEAR is missing with a chance of 0.44 ** BLOCKS. An unrelated item is listed
  with a chance of 0.025. Listed items over RADIUS bits away (five deviations) are put aside.
* Candidates are verified exactly.

The benchmark is a query set: it is split by hash into parts of at most about PART items and
PART_BYTES of text. One part is on the driver and in a worker at a time; with more than one,
each goes over all documents by itself, and its matches are written before the next begins.

Defined results: null and empty texts hold nothing; items without a word match nothing; items
with a null id match as others do, and ids may be of any type; equal items each count; ties of
similarity go to the lowest item (null last), then the earliest window; repeated rows get equal
results; empty tables give no rows, an empty benchmark contaminates nothing; columns besides
the text (and doc_id in the report) are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words, stored
from .simhash import shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 192
BLOCKS = BITS // 16
NEAR = 2
RADIUS = 54
PART = 2_000
PART_BYTES = 8_000_000
_WINDOWS = 4096
#: All 16-bit patterns of at most NEAR bits.
_NEAR = np.array([sum(1 << b for b in bits) for r in range(NEAR + 1) for bits in combinations(range(16), r)], np.uint16)


def spread(hashes: np.ndarray) -> np.ndarray:
    """BITS bits by hash, as 0 and 1 by (hash, bit)."""
    words = [hashes]
    with np.errstate(over="ignore"):
        for _ in range(BITS // 64 - 1):
            more = (words[-1] ^ (words[-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            words.append(more ^ (more >> np.uint64(29)))
    both = np.stack(words, axis=1).astype("<u8")
    return np.unpackbits(both.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1, bitorder="little")


def majority(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints as blocks of 16 bits from the bits' counts among n hashes, by (row, bit)."""
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u2")


def held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Index:
    """Items of one number of words."""

    def __init__(self, size: int, numbers: list[int], hashes: list[np.ndarray]):
        self.size, self.numbers, self.bags = size, numbers, [Counter(h.tolist()) for h in hashes]
        self.shingles = np.unique(np.concatenate(hashes))
        self.prints = np.concatenate([majority(spread(h).sum(axis=0, dtype=np.int64)[None, :], len(h)) for h in hashes])
        #: By block: values in rising order, and the item that each lists.
        self.blocks = []
        for b in range(BLOCKS):
            values = (self.prints[:, b, None] ^ _NEAR).ravel()
            order = np.argsort(values, kind="stable")
            self.blocks.append((values[order], (order // len(_NEAR)).astype(np.int32)))

    def listed(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, item) pairs that some block lists."""
        pairs = []
        for b, (values, items) in enumerate(self.blocks):
            own = np.ascontiguousarray(prints[:, b])
            first = np.searchsorted(values, own)
            n = np.searchsorted(values, own, side="right") - first
            window = np.repeat(np.arange(len(own)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            pairs.append(window * len(self.numbers) + items[at])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.numbers))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Listed (window, item) pairs within RADIUS."""
        window, item = self.listed(prints)
        close = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return window[close], item[close]

    def matches(self, hashes: np.ndarray, similarity: float) -> list[tuple[int, float, int]]:
        """(item number, similarity, first word) of windows, given the document's shingles of this size's kind."""
        k = min(max(1, self.size - SHINGLE + 1), len(hashes))
        known = held(hashes, self.shingles)
        if not known.any():
            return []
        some = np.concatenate([[0], np.cumsum(known)])
        starts = np.flatnonzero(some[k:] > some[:-k])
        out = []
        # runs of windows, each with running sums of its own shingles only
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for at in range(0, len(part), _WINDOWS):
                own = part[at : at + _WINDOWS]
                first, end = own[0], own[-1] + k
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(spread(hashes[first:end]), axis=0, dtype=np.int32)])
                prints = majority(sums[own - first + k] - sums[own - first], k)
                for w, item in zip(*self.candidates(prints), strict=True):
                    s = int(own[w])
                    got = weighted_jaccard(Counter(hashes[s : s + k].tolist()), self.bags[item])
                    if got >= similarity:
                        out.append((self.numbers[item], got, s))
        return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = (a & b).total()
    return both / (a.total() + b.total() - both)


class Benchmark:
    def __init__(self, items: list[tuple[Any, str | None]], similarity: float = SIMILARITY):
        self.similarity, self.ids = similarity, [i for i, _ in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            if words := lower_words(text):
                by_size[len(words)].append((number, shingle_hashes(words, SHINGLE)))
        self.indexes = [Index(n, [i for i, _ in own], [h for _, h in own]) for n, own in sorted(by_size.items())]
        self.shingles = np.unique(np.concatenate([x.shingles for x in self.indexes if x.size >= SHINGLE] or [np.empty(0, np.uint64)]))

    def search(self, text: str | None) -> list[tuple[Any, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each matching item."""
        words = lower_words(text)
        best: dict[int, tuple[float, int, int]] = {}
        kinds: dict[int, np.ndarray] = {}
        for index in self.indexes if words else []:
            k = min(index.size, SHINGLE)
            if k not in kinds:
                kinds[k] = shingle_hashes(words, k)
                if k == SHINGLE and not held(kinds[k], self.shingles).any():
                    break
            if len(kinds[k]) < self.similarity * (index.size - k + 1):
                break
            for number, got, start in index.matches(kinds[k], self.similarity):
                if number not in best or got > best[number][0]:
                    best[number] = (got, start, min(index.size, len(words)))
        return [(self.ids[number], *best[number]) for number in sorted(best)]


def _searched(items: list[tuple[Any, str]], kind: str, similarity: float):
    names = ("item", "similarity", "start", "words")

    @F.pandas_udf(f"array<struct<item:{kind},similarity:double,start:int,words:int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Benchmark(items, similarity)
        for texts in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in index.search(t)] for t in texts], dtype=object)

    return search


def matched(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, part: int = PART, part_bytes: int = PART_BYTES, text_col: str = "text") -> DataFrame:
    """(row, found): each row of docs as a struct, with (item, similarity, start, words) of the items found in its text."""
    items, kind = benchmark.select("item_id", "text").filter("text is not null"), benchmark.schema["item_id"].dataType.simpleString()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // part), -(-size["bytes"] // part_bytes))
    own = lambda i: [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()]
    if parts == 1:
        return docs.select(F.struct("*").alias("row"), _searched(own(0), kind, similarity)(F.col(text_col)).alias("found"))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")))
    hits = [stored(rows.select("rid", _searched(own(i), kind, similarity)(F.col("row")[text_col]).alias("found")).filter(F.size("found") > 0)) for i in range(parts)]
    all_hits = reduce(DataFrame.union, hits).groupBy("rid").agg(F.flatten(F.collect_list("found")).alias("found"))
    return rows.join(all_hits, "rid", "left").select("row", F.coalesce("found", F.array().cast(all_hits.schema["found"].dataType)).alias("found"))


def report(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and the best match of each row."""
    best = F.array_min(F.transform("found", lambda m: F.struct((-m["similarity"]).alias("less"), m["item"].isNull().alias("no"), m["item"].alias("item"), m["start"].alias("start"), m["words"].alias("words"))))
    return matched(docs, benchmark, similarity).select("row.doc_id", "found", best.alias("best")).select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.array_sort("found.item").alias("item_ids"),
        F.col("best.item").alias("best_item"), (-F.col("best.less")).alias("best_similarity"), F.col("best.start").alias("best_start"), F.col("best.words").alias("best_words"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no item, in docs' own columns."""
    return matched(docs, benchmark, similarity).filter(F.size("found") == 0).select("row.*")
