"""Quality rules: an isolation forest over rule statistics of each text.

Statistics are what the rules count, free of length: shares of symbols, of words in upper case,
of words that equal the next one, of repeated lines and of words in repeated windows, letters
a word, and the logarithm of the number of words. The forest sees of each the excess beyond
the range that all but 2 * TAIL of the good labelled rows keep to, so what sound texts differ
in (language, length, numbers, license lines) moves nothing. Trees split a random statistic at
a random value; texts that few splits isolate are anomalous (score 2 ** (-mean path / expected
path)). Ranges and forest are fitted on one half of the labelled ids, told by a hash of the id;
on the other half the threshold is the one with the most (share of bad rows above it) -
GOOD_WEIGHT * (share of good rows above it). A text is kept if it passes the base rules and
scores no more than the threshold. Every labelled id counts, with one row each (of several the
one with the least statistics): quantiles and threshold come from running sums over all sorted
values, not from a sample. Only the forest draws, as its method says: each tree takes PER_TREE
rows of its own out of all rows of the half, those with the least hash of id and tree.

Defined results: a null or empty text has no words and fails the base rules; a null doc_id
never matches a label; labels with a null in either column are not used, of several labels
of one id the lowest counts; without labelled rows of both kinds to calibrate on the base
rules decide alone; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
TREES = 100
PER_TREE = 256
GOOD_WEIGHT = 3.0
#: Good rows beyond each end of a statistic's usual range.
TAIL = 0.001
SEED = 7

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbol_share", "upper_share", "same_as_next_share", "dup_line_share", "repeat_share", "word_length", "log_words"]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text, the first included.

    Windows are compared exactly: ranks of 1, 2, 4, ... words are combined in pairs.
    """
    n = len(words)
    if n < window + 1:
        return 0
    seen: dict[str, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        size += step
        if len(rank) and int(rank.max()) + 1 == len(rank):
            return 0
    often = np.bincount(rank)[rank] > 1
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """COUNTS, then SHARES."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    c, m = max(chars, 1), max(n, 1)
    upper = sum(map(str.isupper, words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return n, chars, symbols, dup_lines, repeats, symbols / c, upper / m, same / m, dup_lines / max(len(lines), 1), repeats / m, chars / m, math.log(m)


def measured(text_col: str = "text"):
    """A struct column of COUNTS and SHARES."""
    schema = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])

    @F.pandas_udf(schema)
    def stats(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([statistics(t) for t in texts], columns=COUNTS + SHARES)
        return out.astype(dict.fromkeys(COUNTS, "int64") | dict.fromkeys(SHARES, "float64"))

    return stats(F.col(text_col))


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: feature (-1 at leaves), split, children, and path length at leaves."""

    def __init__(self, samples: Sequence[np.ndarray], seed: int = SEED):
        """samples: the rows that each tree is grown on."""
        rng = np.random.default_rng(seed)
        self.size = max(map(len, samples))
        limit = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._grow(sample, rng, limit) for sample in samples]

    @staticmethod
    def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
        feature, split, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            k = len(feature)
            for x, v in ((feature, -1), (split, 0.0), (left, k), (right, k), (path, float(depth + expected_path(len(rows))))):
                x.append(v)
            varied = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and depth < limit else []
            if len(varied):
                f = int(rng.choice(varied))
                at = rng.uniform(rows[:, f].min(), rows[:, f].max())
                low = rows[:, f] <= at
                feature[k], split[k] = f, at
                left[k], right[k] = node(rows[low], depth + 1), node(rows[~low], depth + 1)
            return k

        node(sample, 0)
        return tuple(map(np.array, (feature, split, left, right, path)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                low = rows[np.arange(len(rows)), f] <= split[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(expected_path(self.size)), 1e-9))


def running(rows: DataFrame, group: str, value: str, sums: Sequence[str]) -> DataFrame:
    """rows, one for each value of a group, with the columns `sums` summed up over all values up to their own.

    Values are dealt by range; a task sums one range, and only the ranges' totals go along a whole group.
    """
    ordered = materialize(rows.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy(group, "part").agg(*[F.sum(c).alias(c) for c in sums])
    starts = totals.select(group, "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    own = Window.partitionBy(group, "part").orderBy(value)
    summed = ordered.select(group, "part", value, *sums, *[F.sum(c).over(own).alias(f"{c}_own") for c in sums]).join(F.broadcast(starts), [group, "part"])
    return summed.select(group, value, *sums, *[(F.col(f"{c}_own") + F.col(f"{c}_before")).alias(f"{c}_upto") for c in sums])


def quantiles(rows: DataFrame, columns: Sequence[str], at: Sequence[float], n: int) -> np.ndarray:
    """The quantiles of each column over all n rows, linear between neighbours; a row for each of `at`."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).alias("value")) for i, c in enumerate(columns)])).alias("v")).select("v.*")
    counts = running(long.groupBy("stat", "value").agg(F.count("*").alias("n")), "stat", "value", ["n"])
    places = np.array(at) * (n - 1)
    low = np.floor(places).astype(int)
    asked = sorted({*low.tolist(), *np.minimum(low + 1, n - 1).tolist()})
    there = F.filter(F.array(*[F.lit(r).cast("long") for r in asked]), lambda r: (r < F.col("n_upto")) & (r >= F.col("n_upto") - F.col("n")))
    found = {(r.stat, r.place): r.value for r in counts.select("stat", "value", F.explode(there).alias("place")).collect()}
    value = lambda place: np.array([[found[i, int(p)] for i in range(len(columns))] for p in place])
    below, above = value(low), value(np.minimum(low + 1, n - 1))
    return below + (above - below) * (places - low)[:, None]


def calibrated(scores: DataFrame, good_weight: float = GOOD_WEIGHT) -> float:
    """Of all rows of (score, good): the score with the most (share of bad above) - good_weight * (share of good above); of equal ones the highest."""
    each = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).withColumn("all", F.lit(0))
    counts = materialize(running(each, "all", "score", ["good", "bad"]))
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    gain = (bad - F.col("bad_upto")) * float(good) - good_weight * (good - F.col("good_upto")) * float(bad)
    return counts.agg(F.max(F.struct(gain.alias("gain"), "score")).alias("best")).first().best.score


class Model:
    """The usual ranges of good rows, the forest over what goes beyond them, and the threshold."""

    def __init__(self, low: np.ndarray, high: np.ndarray, samples: Sequence[np.ndarray]):
        self.low, self.high = low, high
        self.forest = IsolationForest([self.excess(rows) for rows in samples])
        self.threshold = np.inf

    def excess(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(rows - self.high, 0) + np.minimum(rows - self.low, 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.score(self.excess(rows))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, half and SHARES of every labelled id that passes the base rules; rows: (doc_id, COUNTS, SHARES)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    columns = ["n_words", "n_repeat_words", *SHARES]
    one = rows.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*columns)).alias("s")).select("doc_id", "quality", "s.*").filter(~failed())
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    return one.select("doc_id", (F.col("quality") >= 1).alias("good"), half.alias("half"), *SHARES)


def drawn(rows: DataFrame, n: int, trees: int = TREES, per_tree: int = PER_TREE) -> list[np.ndarray]:
    """For each tree SHARES of per_tree of all n rows (all, if fewer): those with the least hash of id and tree."""
    # far more than per_tree hashes lie below the bound, so that only these are sorted
    bound = min(1.0, (per_tree + 10 * math.sqrt(per_tree)) / n)
    below = (1 << 63) - 1 if bound == 1 else int(bound * 2.0**64) - (1 << 63)
    hashed = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("doc_id", t).alias("h")))
    few = rows.select("doc_id", *SHARES, F.explode(F.filter(hashed, lambda x: x["h"] <= below)).alias("d")).select("d.*", "doc_id", *SHARES)
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("tree").orderBy("h", "doc_id"))).filter(F.col("nth") <= per_tree)
    got = few.select("tree", "nth", *SHARES).toPandas().sort_values(["tree", "nth"])
    return [part[SHARES].to_numpy(float) for _, part in got.groupby("tree")]


def fitted(rows: DataFrame, labels: DataFrame, good_weight: float = GOOD_WEIGHT, tail: float = TAIL) -> Model | None:
    """The model from all labelled ids of rows (doc_id, COUNTS, SHARES); None if there is nothing to calibrate on."""
    seen = materialize(labelled(rows, labels))
    n = {(r.half, r.good): r["count"] for r in seen.groupBy("half", "good").count().collect()}
    if sum(n.values()) < 4 or not {(True, True), (False, True), (False, False)} <= n.keys():
        return None
    low, high = quantiles(seen.filter("half and good"), SHARES, [tail, 1 - tail], n[True, True])
    model = Model(low, high, drawn(seen.filter("half"), n[True, True] + n.get((True, False), 0)))
    model.threshold = calibrated(seen.filter("not half").select("good", scored(model).alias("score")), good_weight)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """As fitted, from texts."""
    return fitted(docs.select("doc_id", measured().alias("s")).select("doc_id", "s.*"), labels)


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def scored(model: Model | None) -> Column:
    """A column: the anomaly of SHARES."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(shares: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(shares.to_numpy(float)))

    return score(F.struct(*SHARES))


def judged(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows of COUNTS and SHARES with base_failed, kept and anomaly."""
    rows = rows.withColumn("base_failed", failed()).withColumn("anomaly", scored(model))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= (model.threshold if model else math.inf)))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and anomaly of each row."""
    rows = stored(docs.select("doc_id", measured().alias("s")).select("doc_id", "s.*"))
    return judged(rows, fitted(rows, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, in docs' own columns."""
    packed = stored(docs.select(measured().alias("s"), F.struct("*").alias("row")))
    model = fitted(packed.select("row.doc_id", "s.*"), labels)
    return judged(packed.select("row", "s.*"), model).filter("kept").select("row.*")
