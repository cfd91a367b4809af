"""Scores by a class-based bigram model: exchange clustering, class transitions, word emissions.

P(text) is the product over its tokens of P(class | class before) * P(token | class). Tokens
are words (A-Z in lower case) and one end a text; the class before the first is the end's.

Every word belongs to a unit: each of the at most HEAD_WORDS most frequent words is a unit of
its own, all others share a unit by their last letters (SUFFIX_UNITS of them), so rare and
unseen words have a class as well. Classes start by frequency rank modulo CLASSES, which puts
the most frequent words into classes of their own. Exchange works on the EXCHANGED most
frequent words and the endings, with the other words in the class of their ending: a pass
counts, over the whole training corpus, how often each unit follows and precedes each class,
gives the log likelihood of the classes that it counted with, and proposes for each unit the
class with the highest likelihood of the class bigrams around it. All or a part of the units
move at once; where the next pass finds a lower likelihood, the moves are taken back and half
as many are tried, so the likelihood that is kept never falls. It ends after PASSES passes, or
when a pass gains less than TOLERANCE of the likelihood. Then every other word of the head is
given the class of the highest likelihood around it, kept again only if the whole gains by it.
The end is a class of its own that never moves. Counts are summed by Spark; the cells of a
unit are at most 2 * CLASSES, whatever the corpus size.

Transitions: (bigrams + TRANSITION * P(class)) / (class before + TRANSITION). Emissions:
(c + EMISSION) / (words in class + EMISSION * (distinct words in class + 1)), where the last
one stands for all unseen words of the class. Both sum to 1.

Counts are exact for all words. Words that occur often enough to be among the at most
HEAD_WORDS most frequent are broadcast (the bound holds by a count threshold, from the
histogram of counts); the others meet their counts in a join on the word.

Defined results: a null or empty text is the end token alone; a null doc_id counts as the empty
text for the fold; repeated rows count each; without training rows all tokens are unseen; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, materialize, stored

CLASSES = 48
EXCHANGED = 12_000
SUFFIX_UNITS = 4_096
SUFFIX = 3
PASSES = 5
TOLERANCE = 1e-4
HEAD_WORDS = 200_000
TRANSITION = 5.0
EMISSION = 0.3
END = b" "  # no word holds a space
FLUSH = 400_000
#: Tokens that one step of a pass counts.
COUNTED = 1 << 20


def suffix_unit(word: bytes) -> int:
    """By the last SUFFIX bytes, and those before them that belong to the same character."""
    n = SUFFIX
    while n < len(word) and word[-n] & 0xC0 == 0x80:
        n += 1
    return zlib.crc32(word[-n:]) % SUFFIX_UNITS


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all training tokens, the end included."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                seen.update(lower_words(text))
                seen[END] += 1
            if len(seen) > FLUSH:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    return train.select(F.col(text_col).alias("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The words at or above a count threshold, by falling count, at most `most`; and the threshold."""
    histogram = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    threshold, got = (histogram[0][0] + 1 if histogram else 1), 0
    for n, k in histogram:
        if got + k > most:
            break
        threshold, got = n, got + k
    found = counts.filter(F.col("n") >= threshold).select("word", "n").toArrow()
    rows = list(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))
    return dict(sorted(rows, key=lambda r: (-r[1], r[0]))), threshold


class Vocabulary:
    """Units of words: the end is 0, then the words of the head by frequency, then endings.

    Words of the head have an index, which is their unit too; other words have the index -1,
    and the array of counts a last element for it.
    """

    def __init__(self, head: dict[bytes, int], ends: int, exchanged: int | None = None):
        words = [w for w in head if w != END]
        self.own = len(words)
        self.size = 1 + self.own + SUFFIX_UNITS
        self.index = {w: i for i, w in enumerate([END, *words])}
        self.counts = np.array([ends, *(head[w] for w in words), 0], np.int64)
        #: By unit: the unit that it moves with during exchange.
        self.leader = np.arange(self.size, dtype=np.int32)
        first = 1 + min(EXCHANGED if exchanged is None else exchanged, self.own)
        self.leader[first : 1 + self.own] = [1 + self.own + suffix_unit(w) for w in words[first - 1 :]]

    def tokens(self, texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray]:
        """The tokens of all texts in turn, an end after each text, and where each text starts."""
        tokens, starts = [], []
        for text in texts:
            starts.append(len(tokens))
            tokens += lower_words(text)
            tokens.append(END)
        return tokens, np.array(starts, np.int64)

    def indices(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int32, len(tokens))

    def of(self, tokens: list[bytes], indices: np.ndarray) -> np.ndarray:
        """Unit of each token."""
        units, first = indices.copy(), 1 + self.own
        for i in np.flatnonzero(indices < 0).tolist():
            units[i] = first + suffix_unit(tokens[i])
        return units


def lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists that begin at starts in values."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def encoded(train: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """The units of each training text, stored once for all passes."""
    shared = vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                tokens, starts = vocabulary.tokens(batch.column(0).slice(at, 512).to_pylist())
                units = vocabulary.of(tokens, vocabulary.indices(tokens))
                yield pa.RecordBatch.from_arrays([lists(starts, pa.array(units))], ["units"])

    return stored(train.select(F.col(text_col).alias("text")).mapInArrow(encode, "units array<int>"))


class _Cells:
    """Counts by (unit, at) as sorted keys, added up whenever many have come."""

    def __init__(self, width: int):
        self.width, self.keys, self.counts, self.waiting = width, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys), self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > 2 * len(self.keys[0]) + COUNTED:
            self.settle()

    def settle(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts, self.waiting = [keys], [np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)], 0

    def rows(self) -> pa.RecordBatch:
        """One row a unit that has any."""
        if self.keys:
            self.settle()
        key, n = (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        unit, at = np.divmod(key, self.width)
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(unit[starts].astype(np.int32)), lists(starts, pa.array(at.astype(np.int32))), lists(starts, pa.array(n))], ["unit", "at", "n"])


def unit_contexts(train: DataFrame, classes: np.ndarray, k: int, leader: np.ndarray, some: np.ndarray | None = None) -> DataFrame:
    """(unit, at, n) for each leading unit: how often it and those it leads follow class c (at = c) and precede it (at = k + c).

    train: rows of units, as encoded gives them; some: which units to count, all by default. A
    task counts all its texts and hands on one row a unit, which bounds the shuffle by tasks *
    units; a unit's rows are added up where they meet.
    """
    schema = "unit int, at array<int>, n array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(2 * k)
        for batch in batches:
            after = batch.column(0).flatten().to_numpy()
            before = np.concatenate([[0], after[:-1]]) if len(after) else after  # a text ends with the unit 0
            for at in range(0, len(after), COUNTED):
                u, v = before[at : at + COUNTED], after[at : at + COUNTED]
                follows, precedes = leader[v].astype(np.int64) * 2 * k + classes[u], leader[u].astype(np.int64) * 2 * k + k + classes[v]
                if some is not None:
                    follows, precedes = follows[some[v]], precedes[some[u]]
                cells.add(np.concatenate([follows, precedes]))
        yield cells.rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(2 * k)
        for batch in batches:
            at = batch.column(1)
            unit = np.repeat(batch.column(0).to_numpy().astype(np.int64), at.value_lengths().to_numpy())
            cells.add(unit * 2 * k + at.flatten().to_numpy(), batch.column(2).flatten().to_numpy())
        yield cells.rows()

    return materialize(train.mapInArrow(count, schema).repartition("unit").mapInArrow(add, schema))


def class_bigrams(units: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts by (class, class after): at most k * k rows a task come together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            path = classes[batch.column(0).flatten().to_numpy()]
            if len(path):
                total += np.bincount(np.concatenate([[0], path[:-1]]) * k + path, minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    out = np.zeros(k * k)
    for r in units.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def log_likelihood(bigrams: np.ndarray) -> float:
    """Of the class bigrams, less the part that the words' own counts give whatever their classes are."""
    part = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return part(bigrams) - part(bigrams.sum(axis=0)) - part(bigrams.sum(axis=1))


def best_classes(contexts: DataFrame, classes: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The best class of each unit that has contexts, given the class bigrams that all units make now.

    Moving unit u into class c scores the bigrams around u by how the members of c meet those
    contexts: sum of follows(u, d) * log P(c | d) and precedes(u, d) * log P(d | c), less
    u's count times the log of the class's size, which emissions pay for.
    """
    k = len(bigrams)
    log_after = np.log((bigrams + 0.5) / (bigrams.sum(axis=1, keepdims=True) + 0.5 * k))
    log_size = np.log(bigrams.sum(axis=1) + 1.0)

    @F.pandas_udf("int")
    def best(ats: pd.Series, counts: pd.Series) -> pd.Series:
        rows = np.zeros((len(ats), 2 * k))
        for i, (at, n) in enumerate(zip(ats, counts, strict=True)):
            rows[i, at] = n
        score = rows[:, :k] @ log_after + rows[:, k:] @ log_after.T - rows[:, :k].sum(axis=1, keepdims=True) * log_size
        score[:, 0] = -np.inf
        return pd.Series(score.argmax(axis=1))

    out = classes.copy()
    found = contexts.filter("unit > 0").select("unit", best("at", "n").alias("c")).toArrow()
    out[found["unit"].to_numpy()] = found["c"].to_numpy()
    return out


def clustered(units: DataFrame, vocabulary: Vocabulary, k: int, passes: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each unit, class bigrams, and the log likelihoods that were kept, one after the other."""
    leader = vocabulary.leader
    classes = np.zeros(vocabulary.size, np.int64)
    classes[1:] = 1 + np.arange(vocabulary.size - 1) % (k - 1)
    classes = classes[leader]
    kept: list[float] = []
    share = 1.0
    for i in range(passes + 1):
        bigrams = class_bigrams(units, classes, k)
        now = log_likelihood(bigrams)
        if not kept or now > kept[-1]:
            gain = (now - kept[-1]) / max(abs(now), 1.0) if kept else np.inf
            kept.append(now)
            best, best_bigrams = classes, bigrams
            if gain < tolerance or i == passes:
                break
            proposed = best_classes(unit_contexts(units, classes, k, leader), classes, bigrams)[leader]
        else:
            share /= 2
        moving = np.random.default_rng(i).random(vocabulary.size) < share
        classes = np.where(moving[leader], proposed, best)
    # the other words of the head, each by its own contexts
    others = leader != np.arange(len(leader))
    if others.any():
        contexts = unit_contexts(units, best, k, np.arange(len(leader), dtype=np.int32), others)
        classes = best_classes(contexts, best, best_bigrams)
        bigrams = class_bigrams(units, classes, k)
        if (now := log_likelihood(bigrams)) > kept[-1]:
            kept.append(now)
            best, best_bigrams = classes, bigrams
    return best, best_bigrams, kept


class Model:
    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, log_transition: np.ndarray, log_room: np.ndarray, tokens: int, types: int, likelihoods: list[float]):
        self.vocabulary, self.classes, self.log_transition, self.log_room = vocabulary, classes, log_transition, log_room
        self.tokens, self.types, self.likelihoods = tokens, types, likelihoods


def fit(train: DataFrame, counts: DataFrame, k: int = CLASSES, passes: int = PASSES) -> Model:
    """The model from all training rows; counts: word_counts(train)."""
    context = train.sparkSession.sparkContext
    head, _ = head_of(counts, HEAD_WORDS)
    ends = counts.filter(F.col("word") == F.lit(bytearray(END))).first()
    vocabulary = Vocabulary(head, ends["n"] if ends else 0)
    shared = context.broadcast(vocabulary)
    classes, bigrams, likelihoods = clustered(encoded(train, shared), vocabulary, k, passes)
    sizes = bigrams.sum(axis=0)
    transition = (bigrams + TRANSITION * ((sizes + 1) / (sizes.sum() + k))[None, :]) / (bigrams.sum(axis=1, keepdims=True) + TRANSITION)

    @F.pandas_udf("long")
    def unit(words: pd.Series) -> pd.Series:
        tokens = [bytes(w) for w in words]
        return pd.Series(shared.value.of(tokens, shared.value.indices(tokens)).astype(np.int64))

    by_unit = counts.groupBy(unit("word").alias("unit")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    n, types = np.zeros(k), np.zeros(k)
    at = classes[by_unit["unit"].to_numpy(np.int64)]
    np.add.at(n, at, by_unit["n"].to_numpy(float))
    np.add.at(types, at, by_unit["types"].to_numpy(float))
    room = n + EMISSION * (types + 1)
    return Model(vocabulary, classes, np.log10(transition), np.log10(room), int(by_unit["n"].sum()), int(by_unit["types"].sum()), likelihoods)


def scored(docs: DataFrame, held_out: Column, text_col: str = "text") -> DataFrame:
    """Learns from rows where held_out is false; doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (log10 probabilities) of each row."""
    rows = docs.select("doc_id", F.col(text_col).alias("text"), held_out.alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    counts = materialize(word_counts(train))
    model = fit(train, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    schema = f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, tokens long, known long, score double, log_c double, log_e double, words array<binary>, ns array<long>"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each text's frequent words give, and its rare words with their numbers."""
        m = shared.value
        v, last = m.vocabulary, np.arange(len(m.vocabulary.counts)) == len(m.vocabulary.counts) - 1
        log_c, log_e = (np.where(last, 0.0, np.log10(v.counts + x)) for x in (1.0, EMISSION))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                tokens, starts = v.tokens(part.column(3).to_pylist())
                found = v.indices(tokens)
                path = m.classes[v.of(tokens, found)]
                steps = m.log_transition[np.concatenate([[0], path[:-1]]), path] - m.log_room[path]
                words, n, first = [], [], []
                rare = np.flatnonzero(found < 0)
                for own in np.split(rare, np.searchsorted(rare, starts[1:])):
                    first.append(len(words))
                    seen = Counter(tokens[i] for i in own.tolist())
                    words += seen.keys()
                    n += seen.values()
                add = lambda x: pa.array(np.add.reduceat(x, starts))
                own = [pa.array(np.diff(np.append(starts, len(tokens)))), add((v.counts[found] > 0).astype(np.int64)), add(steps), add(log_c[found]), add(log_e[found])]
                rare_words, rare_n = lists(np.array(first), pa.array(words, pa.binary())), lists(np.array(first), pa.array(n, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *own, rare_words, rare_n], ["rid", "doc_id", "held_out", "tokens", "known", "score", "log_c", "log_e", "words", "ns"])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    each = numbered.mapInArrow(parts, schema)
    each = each.select("*", F.posexplode_outer(F.arrays_zip("words", "ns")).alias("pos", "w"))
    # a text's own numbers go with its first rare word, or with a word of its own that no count has
    once = F.coalesce("pos", F.lit(0)) == 0
    no_word = F.concat(F.lit(" "), F.col("rid").cast("string")).cast("binary")
    out = each.select("rid", "doc_id", "held_out", F.coalesce("w.words", no_word).alias("word"), F.coalesce("w.ns", F.lit(0)).alias("n"), *[F.when(once, F.col(c)).otherwise(0).alias(c) for c in ("tokens", "known", "score", "log_c", "log_e")])
    met = out.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum("score").alias("score"), F.sum(F.col("log_c") + F.col("n") * F.log10(c + 1)).alias("log_c"), F.sum(F.col("log_e") + F.col("n") * F.log10(c + EMISSION)).alias("log_e"),
    )
    low = float(np.log10(model.tokens + model.types + 1))
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * low).alias("base_score"), (F.col("score") + F.col("log_e")).alias("score"),
    )
