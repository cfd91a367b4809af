"""Language of a text: unigram pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece. A word's likelihood is the sum over all ways
to cut it into pieces of the product of their probabilities, by the forward algorithm; a
text's is the product over its words. Words are runs of letters, in lower case, with the
word mark before them; words of any length are taken whole in training and in scoring.

Training is expectation maximization. Words are counted by language over the whole corpus and
the counts stored; each step runs the forward and backward algorithm on every distinct word of
a language with that language's probabilities, which gives the expected uses of each piece.
Smoothed, these are the next probabilities. It starts from one Zipf distribution over the
ranks of the vocabulary and ends when a step raises the log likelihood by less than TOLERANCE
of it, or after STEPS steps; Model.likelihoods has it by step. Each task sums its words' expectations, so
only (language, piece) sums are sent to the driver: at most the vocabulary size times the
number of languages.

score is the posterior of the chosen language among the learned ones, all equally likely
before; it rises with the length of a text.

Defined results: a null text and one without a letter are `und` with score 0; characters that
no piece covers have one shared probability; rows with a null language teach nothing; with no
training rows all are `und`; ties go to the first language by name; repeated rows get equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTERS = regex.compile(r"\p{L}+")
MARK = "▁"
UNKNOWN = 0  # the piece id of a character that no piece covers
SMOOTHING = 0.1
STEPS = 4
TOLERANCE = 1e-2
#: Words of up to this many letters are searched together, by length; longer ones one by one.
SHORT = 40
#: Words that a worker keeps the likelihoods of; others are scored when they come.
CACHE = 600_000
FLUSH = 200_000
#: Each character multiplies a path by this, which keeps long words within a double's range; it is taken out again.
LIFT = 16.0
#: A word with a path sum below this is searched again in logarithms.
LEAST = 1e-250
#: Multiplier of the rolling hashes that substrings are looked up by, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def letter_pieces(model_path: str) -> list[str]:
    """The vocabulary's pieces of letters only, with or without the word mark, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return list(dict.fromkeys(p for p in pieces if p == MARK or LETTERS.fullmatch(p.removeprefix(MARK)) and p == p.lower()))


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _prefixes(words: list[str]) -> np.ndarray:
    """Rolling hashes of all prefixes of words of one length, by (length, word); the hash of a
    substring is (prefix[end] - prefix[start]) * INVERSE ** start."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).T
    powers = np.array([pow(BASE, i, 1 << 64) for i in range(n)], np.uint64)
    out = np.zeros((n + 1, len(words)), np.uint64)
    np.cumsum(_mixed(codes) * powers[:, None], axis=0, out=out[1:])
    return out


class Lattice:
    """All segmentations of words over the pieces; piece ids are ranks plus one, 0 is UNKNOWN."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        by_length = defaultdict(list)
        for i, piece in enumerate(pieces):
            by_length[len(piece)].append(i)
        #: By number of characters: hashes of the pieces in rising order, and their ids.
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, which in by_length.items():
            h = _prefixes([pieces[i] for i in which])[n]
            order = np.argsort(h)
            self.hashes[n] = (h[order], np.array(which)[order].astype(np.int32) + 1)

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            out.add_word(piece, (len(piece), i + 1))
        out.make_automaton()
        return out

    def arcs(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """For words of one length: (start, end, piece id by word or -1 where there is none), by end."""
        prefix, out = _prefixes(words), []
        back = [np.uint64(pow(INVERSE, i, 1 << 64)) for i in range(len(prefix))]
        for end in range(1, len(prefix)):
            for start in range(max(0, end - self.longest), end):
                if end - start not in self.hashes:
                    ids = np.full(len(words), -1, np.int32)
                else:
                    known, pieces = self.hashes[end - start]
                    h = (prefix[end] - prefix[start]) * back[start]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    ids = np.where(known[at] == h, pieces[at], -1).astype(np.int32)
                if end - start == 1:
                    ids[ids < 0] = UNKNOWN
                if (ids >= 0).any():
                    out.append((start, end, ids))
        return out

    @staticmethod
    def forward(arcs: list[tuple[int, int, np.ndarray]], p: np.ndarray, n: int, words: int) -> np.ndarray:
        """alpha by (position, word, language); p: by (piece, language), with a last row of zeros."""
        alpha = np.zeros((n + 1, words, p.shape[1]))
        alpha[0] = 1
        for start, end, ids in arcs:
            alpha[end] += alpha[start] * p[ids] * LIFT ** (end - start)
        return alpha

    def batches(self, words: list[str], size: int = 4096) -> Iterator[tuple[int, list[int]]]:
        """Word numbers of one length each; words over SHORT letters alone."""
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, which in by_length.items():
            step = size if n <= SHORT + 1 else 1
            for at in range(0, len(which), step):
                yield n, which[at : at + step]

    def score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log likelihoods by (word, language)."""
        out = np.empty((len(words), p.shape[1]))
        for n, part in self.batches(words):
            if n > SHORT + 1:
                out[part] = self.long_score(words[part[0]], p)
                continue
            alpha = self.forward(self.arcs([words[i] for i in part]), p, n, len(part))
            low = (alpha < LEAST).any(axis=(0, 2))
            out[part] = np.log(np.maximum(alpha[n], LEAST)) - n * np.log(LIFT)
            for i in np.array(part)[low]:
                out[i] = self.long_score(words[i], p)
        return out

    def long_arcs(self, word: str) -> Iterator[list[tuple[int, int]]]:
        """By end: (size, piece) of the pieces that end there."""
        ending = defaultdict(list)
        for last, (size, piece) in self.automaton.iter(word):
            ending[last + 1].append((size, piece))
        for end in range(1, len(word) + 1):
            own = ending.pop(end, [])
            yield own if any(size == 1 for size, _ in own) else [*own, (1, UNKNOWN)]

    def long_score(self, word: str, p: np.ndarray) -> np.ndarray:
        """As score, for one word of any length and pieces of any probability: in logarithms."""
        alphas = [np.zeros(p.shape[1])]
        for own in self.long_arcs(word):
            alphas = [*alphas[-self.longest :], np.logaddexp.reduce([alphas[-size] + np.log(p[piece]) for size, piece in own])]
        return alphas[-1]

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray, total: np.ndarray) -> float:
        """Adds the expected uses of each piece in words to total; gives the log likelihood. p: by piece, with a last zero."""
        likely = 0.0
        for n, part in self.batches(words):
            weight = counts[part]
            if n > SHORT + 1:
                likely += self.long_expected(words[part[0]], float(weight[0]), p, total)
                continue
            arcs = self.arcs([words[i] for i in part])
            alpha = self.forward(arcs, p[:, None], n, len(part))[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[n] = 1
            low = (alpha < LEAST).any(axis=0)
            norm = np.where(low, 0, weight / np.maximum(alpha[n], LEAST))
            used, uses = [], []
            for start, end, ids in sorted(arcs, key=lambda x: -x[0]):
                through = p[ids] * LIFT ** (end - start) * beta[end]
                beta[start] += through
                used.append(ids), uses.append(alpha[start] * through * norm)
            # the id -1 falls on a last cell that is left out
            total += np.bincount(np.concatenate(used) + 1, np.concatenate(uses), len(total) + 1)[1:]
            likely += float((weight * (np.log(np.maximum(alpha[n], LEAST)) - n * np.log(LIFT)))[~low].sum())
            for i in np.array(part)[low]:
                likely += self.long_expected(words[i], float(counts[i]), p, total)
        return likely

    def long_expected(self, word: str, count: float, p: np.ndarray, total: np.ndarray) -> float:
        """As expected, for one word: in logarithms."""
        arcs, log_p = list(self.long_arcs(word)), np.log(np.maximum(p, np.finfo(float).tiny))
        alpha = [0.0]
        for own in arcs:
            alpha.append(float(np.logaddexp.reduce([alpha[-size] + log_p[piece] for size, piece in own])))
        beta = np.full(len(word) + 1, -np.inf)
        beta[-1] = 0.0
        for end in range(len(word), 0, -1):
            for size, piece in arcs[end - 1]:
                through = log_p[piece] + beta[end]
                beta[end - size] = np.logaddexp(beta[end - size], through)
                total[piece] += count * np.exp(alpha[end - size] + through - alpha[-1])
        return count * alpha[-1]


def pieces_with_zero(p: np.ndarray) -> np.ndarray:
    """p by (piece, language), and a last row of zeros, which the id -1 finds."""
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def zipf(n: int) -> np.ndarray:
    p = 1.0 / (np.arange(n + 1) + 10)
    p[UNKNOWN] = 1e-6
    return pieces_with_zero((p / p.sum())[:, None])


class Model:
    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray, likelihoods: list[float]):
        self.pieces, self.langs, self.p, self.likelihoods = pieces, langs, p, likelihoods
        self.key = uuid.uuid4().hex


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over every row of docs that has a text and a language."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(lang, w, n) for lang, own in seen.items() for w, n in own.items()], columns=["lang", "word", "n"])
            seen.clear()
            return out

        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > FLUSH:
                yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", smoothing: float = SMOOTHING, steps: int = STEPS, tolerance: float = TOLERANCE) -> Model:
    """Learns from every row of docs that has a text and a language."""
    counts = stored(word_counts(docs, text_col, lang_col))
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    p = np.repeat(zipf(len(pieces)), max(1, len(langs)), axis=1)
    likelihoods: list[float] = []
    for _ in range(steps if langs else 0):
        now, p = _step(counts, pieces, langs, p, smoothing)
        likelihoods.append(now)
        if len(likelihoods) > 1 and now - likelihoods[-2] < tolerance * abs(now):
            break
    return Model(pieces, langs, p, likelihoods)


def _step(counts: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, smoothing: float) -> tuple[float, np.ndarray]:
    """The log likelihood under p, and the next p."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, total, likely = worker_lattice(tuple(pieces)), np.zeros((len(langs), len(p))), 0.0
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                k = langs.index(lang)
                likely += lattice.expected([MARK + w for w in own["word"]], own["n"].to_numpy(float), p[:, k], total[k])
        lang, piece = np.nonzero(total)
        yield pd.DataFrame({"lang": np.append(lang, -1), "piece": np.append(piece, -1), "n": np.append(total[lang, piece], likely)})

    found = counts.mapInPandas(sums, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    known = found[found["lang"] >= 0]
    out = np.full((len(pieces) + 1, len(langs)), smoothing)
    np.add.at(out, (known["piece"].to_numpy(), known["lang"].to_numpy()), known["n"].to_numpy())
    return float(found["n"][found["lang"] < 0].sum()), pieces_with_zero(out / out.sum(axis=0))


@functools.lru_cache(maxsize=1)
def worker_lattice(pieces: tuple[str, ...]) -> Lattice:
    """One lattice for all tasks of a worker."""
    return Lattice(list(pieces))


class Scorer:
    """Likelihoods of words under a model; those of the first CACHE words are kept."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.lattice, self.p = worker_lattice(tuple(pieces)), p
        self.known: dict[str, int] = {}
        self.likely = np.zeros((1024, p.shape[1]))

    def of(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """By text: the sum over its words, by language."""
        known = self.known
        fresh = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in known]
        n = len(known)
        if n + len(fresh) > len(self.likely):
            self.likely = np.vstack([self.likely, np.zeros((n + 2 * len(fresh), self.p.shape[1]))])
        self.likely[n : n + len(fresh)] = self.lattice.score([MARK + w for w in fresh], self.p)
        known.update((w, n + i) for i, w in enumerate(fresh))
        for words in texts:
            yield self.likely[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        for w in fresh[max(0, CACHE - n) :]:
            del known[w]


_scorers: dict[str, Scorer] = {}


def worker_scorer(key: str, pieces: list[str], p: np.ndarray) -> Scorer:
    """One scorer for all tasks of a worker that use a model."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(pieces, p)
    return _scorers[key]


def predicted(model: Model, text: str | Column = "text") -> Column:
    """A struct column of lang_pred and score."""
    pieces, langs, p, key = model.pieces, model.langs, model.p, model.key

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = worker_scorer(key, pieces, p)
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                each = [words_of(t) for t in texts.iloc[at : at + 512]]
                for words, total in zip(each, scorer.of(each) if langs else each, strict=True):
                    if not words or not langs:
                        out.append(("und", 0.0))
                        continue
                    best = int(total.argmax())
                    out.append((langs[best], float(1 / np.exp(total - total[best]).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"]).astype({"score": "float64"})

    return guess(F.col(text) if isinstance(text, str) else text)
