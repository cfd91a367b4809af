"""Importance resampling toward a target distribution: hashed word features weighed by two corpora's counts.

A feature is a run of 1 to ORDER words; its bucket is the crc32 of its UTF-8 bytes modulo BUCKETS.
Each task keeps a trie of the words that it meets: a node is a feature, its children are the
features that are one word longer. A node holds the feature's crc32, continued from its
parent's state by a space and the word, and how often it occurs. The nodes' counts are summed
by bucket when the task ends or the trie has MOST_NODES nodes, and Spark adds up these totals.
A second pass walks the same paths with a bucket's gain attached to each node and adds up the
gains of a document's features. Only the bucket totals, at most BUCKETS of them, reach the
driver and go back to the tasks.

The draw is by Gumbel keys: score is the weight plus a noise that depends on doc_id alone, and
the highest scores are taken without replacement. Rows are ranked by a range partitioning and
one count a partition, so no task holds more than its range.

Defined results: a null or empty text, and one without a word, has no features and weight 0;
a null doc_id has the noise of the empty id and comes last among equals; repeated rows count
each time and get ranks of their own; ties of score go to the smaller doc_id; an empty table
of documents gives no rows, an empty target counts nothing; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ORDER = 1
BUCKETS = 10_000
#: Nodes that a task's trie holds before it is emptied; the results do not depend on it.
MOST_NODES = 400_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
_STEP = 1 << 16
#: Digits and letters stay, A-Z in lower case, bytes of other characters than ASCII too; all else parts words.
_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII digits, letters (A-Z in lower case) and other characters than ASCII, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class _Edges(dict):
    """Child nodes by their way from the parent, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, way):
        self[way] = node = self.make(way)
        return node


class Trie:
    """Word runs as paths; state holds each node's crc32."""

    def __init__(self, order: int = ORDER):
        self.order, self.state = order, []
        self.first = _Edges(lambda word: self._node(zlib.crc32(word)))
        self.later = _Edges(lambda way: self._node(zlib.crc32(b" " + way[1], self.state[way[0]])))

    def _node(self, state: int) -> int:
        self.state.append(state)
        return len(self.state) - 1

    def __len__(self) -> int:
        return len(self.state)

    def paths(self, words: list[bytes], starts: int) -> list[int]:
        """The nodes of all runs that begin at one of the first so many words."""
        level = list(map(self.first.__getitem__, words[:starts]))
        out = level
        for k in range(1, self.order):
            level = [self.later[way] for way in zip(level, words[k:])]
            out = out + level
        return out


def steps(words: list[bytes], order: int) -> Iterator[tuple[list[bytes], int]]:
    """A long text's words in parts that share no start of a run."""
    for at in range(0, len(words), _STEP):
        yield words[at : at + _STEP + order - 1], min(_STEP, len(words) - at)


def bucket_totals(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, trie, counts = np.zeros(buckets, np.int64), Trie(order), np.zeros(0, np.int64)

        def merged() -> None:
            np.add.at(totals, np.array(trie.state, np.int64) % buckets, counts)

        for frame in frames:
            for text in frame["text"]:
                for words, starts in steps(words_of(text), order):
                    met = np.bincount(trie.paths(words, starts), minlength=len(counts))
                    met[: len(counts)] += counts
                    counts = met
                    if len(trie) >= MOST_NODES:
                        merged()
                        trie, counts = Trie(order), np.zeros(0, np.int64)
        merged()
        some = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": totals[some]})

    parts = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * the logarithm of the smoothed ratio of target to raw frequency), by bucket."""
    s, t = sum(raw.values()), sum(target.values())
    ratio = lambda b: float(target.get(b, 0) + 1) * float(s + buckets) / (float(raw.get(b, 0) + 1) * float(t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weights(gains: list[int], text_col: str = "text", order: int = ORDER) -> Column:
    """A column: the text's number of words and features, and the sum of its features' gains."""
    buckets = len(gains)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, of_node = Trie(order), []
        for texts in batches:
            out = []
            for text in texts:
                words, n, weight = words_of(text), 0, 0
                for part, starts in steps(words, order):
                    if len(trie) >= MOST_NODES:
                        trie, of_node = Trie(order), []
                    nodes = trie.paths(part, starts)
                    of_node += [gains[c % buckets] for c in trie.state[len(of_node) :]]
                    n, weight = n + len(nodes), weight + sum(map(of_node.__getitem__, nodes))
                out.append((len(words), n, weight))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"], dtype="int64")

    return weigh(F.col(text_col))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel variate that the id decides)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def counted(rows: DataFrame) -> dict[int, int]:
    """Bucket totals on the driver, one number a bucket."""
    return {r.bucket: r.n for r in rows.collect()}


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs; rank is null where the row is not drawn.

    percent of the rows with least_words or more are drawn, those of the highest scores.
    """
    gains = bucket_gains(counted(bucket_totals(docs, text_col, order, buckets)), counted(bucket_totals(target, text_col, order, buckets)), buckets)
    rows = docs.select(F.col(id_col).alias("doc_id"), weights(gains, text_col, order).alias("w")).select("doc_id", "w.*")
    # written first, since sampling the range bounds would weigh the texts a second time
    rows = materialize(rows.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("may")))
    by = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # written once: range bounds are sampled, and both the counts and the ranks must see the same ones
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("mid")))
    placed = placed.select("*", F.shiftright("mid", 33).alias("part"), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("may").alias("may"))
    # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    take = (counts.agg(F.sum("may")).first()[0] or 0) * percent // 100
    rank = F.col("before") + F.col("nth") + 1
    return placed.join(F.broadcast(before), "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("may") & (rank <= take), rank).alias("rank"))
