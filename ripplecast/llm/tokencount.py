"""Token counts of a unigram tokenizer by a Viterbi search that carries counts only.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character of a word;
dynamic programming keeps, for each end, the best score and the number of pieces on the best
path, without pieces or back pointers. Ties follow the tokenizer's rule: starts are visited
from left to right and only a strictly better score replaces, so of equal paths the one
whose last piece is longest stays. A character that no one-character piece matches may be
an unknown of score (least score - 10); neighbouring unknowns count as one token.

The vocabulary is a fixed public one, whose file holds merge ranks but no probabilities;
pieces get the Zipf probability of their rank. Words are cut at white space and start with
the word mark. Counts equal those of tokenizers' Unigram model with the same pieces.
The first CACHE distinct words that a worker meets are searched once.

Defined results: a null or empty text has no words and 0 tokens; repeated rows give equal
rows; a null doc_id stays null; an empty table gives no rows; other columns are not read.
Very long words take time in proportion to their length.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000


def zipf_pieces(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file, by rank, with Zipf log probabilities; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return [(p, -math.log(r + 1) - total) for r, p in enumerate(pieces)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """(tokens, unknown tokens) of one word."""
        n = len(word)
        best, count, unk, last_unk = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            single = False
            # matches with one end come longest first, which is the order of their starts
            while ahead is not None and ahead[0] == end - 1:
                size, score = ahead[1]
                start = end - size
                if best[start] + score > best[end]:
                    best[end], count[end], unk[end], last_unk[end] = best[start] + score, count[start] + 1, unk[start], False
                single |= size == 1
                ahead = next(matches, None)
            if not single and best[end - 1] + self.unknown > best[end]:
                more = not last_unk[end - 1]
                best[end], count[end], unk[end], last_unk[end] = best[end - 1] + self.unknown, count[end - 1] + more, unk[end - 1] + more, True
        return count[n], unk[n]

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown tokens)."""
        words = text.split() if text else []
        known = self.known
        tokens = unknown = 0
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.word(MARK + w)
                if len(w) <= 64 and len(known) < CACHE:
                    known[w] = got
            tokens += got[0]
            unknown += got[1]
        return len(words), tokens, unknown


@functools.lru_cache(maxsize=1)
def worker_counter(model_path: str) -> Counter:
    """One automaton and cache for all tasks of a worker."""
    return Counter(zipf_pieces(model_path))


def count_tokens(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens and n_unknown of each row."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = worker_counter(model_path)
        for texts in batches:
            yield pd.DataFrame(np.array([counter.text(t) for t in texts], np.int64).reshape(-1, 3), columns=["n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counts("text").alias("c")).select("doc_id", "n_bytes", "c.*")
