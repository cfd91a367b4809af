"""Packing of tokenized documents into sequences by bin completion.

Each document is its token ids and an end id; longer ones than a sequence are cut into full
pieces and a rest. Packing depends on the pieces' lengths only, so the search works on a
histogram with one counter a length (at most CAPACITY of them, whatever the corpus size):

* Bin completion takes the longest piece left and lists the undominated fillings of the rest
  of its sequence, the least waste first: a filling is dominated if a piece that is left can
  take the place of one or more of its pieces that fit into it. A single piece that fits
  exactly dominates all others. Bit sets of the sums that the shorter lengths can still make
  lead the enumeration, so it meets no dead end and needs no limit; it is lazy, so only as
  many fillings are made as the search asks for.
* Branch and bound takes a filling for as many sequences as the counters allow, and on the way
  back for half as many, a quarter and so on down to one, so every plan can be reached. A
  branch ends where its waste leaves no room for fewer sequences than the incumbent has.
* Best fit decreasing gives the first incumbent. The search ends by proof: at the lower bound
  ceil(total / CAPACITY), or when the tree is used up; `nodes` is the one limit of effort, in
  fillings looked at, after which the incumbent stands (None: no limit). Packing is whole in every case.

A plan is a list of patterns with a number of sequences each; its size is bounded by the
number of lengths. Rows are then placed in parallel: a piece's rank among those of its length
picks its pattern, sequence and offset. Ranks come from counts by (partition, length), so no
length is gathered in one task.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for
itself; a null doc_id stays null and ids of any type stay exact; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
END_ID = 0
NODES = 20_000
CACHE = 300_000
SLOTS = 1 << 22
END = END_ID.to_bytes(4, "little")
#: Words of letters, digits and signs that no normalization of the tokenizer but lower case can change.
PLAIN = r"[!-~\u00a1-\u012f\u0131-\u024f]+"
#: Byte-level alphabet of BPE vocabularies: printable bytes stand for themselves, others follow from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


# --- tokens ------------------------------------------------------------------------------


class WordCache:
    """Ids of texts from those of their words, as little-endian bytes.

    The tokenizer cuts at white space before all else and keeps none, so a text's ids are its
    words' ids in turn. A plain word is cut further by the tokenizer's own pattern, and only
    parts that are not cached go through its merges. The first CACHE distinct words and as
    many parts that a worker meets twice (by SLOTS marks under their hashes, so a few of those
    met once get in) stay in its caches, which later tasks of the same worker use again; others
    are encoded when they come. Words met once, most of the distinct ones, take no memory.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.met_words, self.met_parts = bytearray(SLOTS), bytearray(SLOTS)
        with open(tokenizer_path, encoding="utf-8") as f:
            kind = json.load(f)
        added = "|".join(regex.escape(x["content"]) for x in kind["added_tokens"])
        self.plain = regex.compile(f"(?!.*?(?:{added})){PLAIN}" if added else PLAIN)
        self.pattern = self._pattern(kind)

    @staticmethod
    def _pattern(kind: dict) -> regex.Pattern | None:
        """The pattern that words are cut by, if lower case, that pattern and bytes are all that comes before the merges."""
        steps = [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])]
        cuts = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        usual = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and kind["model"]["type"] == "BPE"
        if usual and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]:
            return regex.compile(cuts[0]["pattern"]["Regex"])
        return None

    @staticmethod
    def _again(word: str, met: bytearray) -> bool:
        slot = hash(word) % SLOTS
        if met[slot]:
            return True
        met[slot] = 1
        return False

    def encode(self, word: str) -> bytes:
        """Ids of a word without spaces."""
        if self.pattern is None or not self.plain.fullmatch(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in self.pattern.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                # of ASCII, a word has signs only that stand for themselves
                alphabet = part if part.isascii() else part.encode().decode("latin-1").translate(ALPHABET)
                ids = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(alphabet)])
                if len(self.parts) < CACHE and self._again(part, self.met_parts):
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        words = text.replace("\n", " ").split(" ") if text else []
        parts = list(map(self.known.get, words))
        if None in parts:
            here: dict[str, bytes] = {}
            for i, part in enumerate(parts):
                if part is None:
                    if (word := words[i]) not in here:
                        here[word] = self.encode(word)
                    parts[i] = here[word]
            if len(self.known) + len(here) <= CACHE:
                self.known.update((w, x) for w, x in here.items() if self._again(w, self.met_words))
        return b"".join(parts) + END


@functools.lru_cache(maxsize=1)
def word_cache(tokenizer_path: str) -> WordCache:
    return WordCache(tokenizer_path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of a length in a partition, from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                out = []
                for row, text in enumerate(own.column(2).to_pylist()):
                    raw = memoryview(words.ids(text))
                    for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                        length = min(capacity, len(raw) // 4 - start)
                        out.append((row, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), int(seen[length])))
                        seen[length] += 1
                row, piece, start, length, crc, nth = (np.array(x, np.int64) for x in zip(*out, strict=True))
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(where), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc), own.column(1).take(where), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.spark_partition_id().alias("part"), "text")
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, part int, nth long")


# --- plan --------------------------------------------------------------------------------

Pattern = tuple[int, ...]


class _Lengths:
    """Counters by length, with the lengths in use in rising order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, pattern: Pattern, times: int) -> None:
        for k in pattern:
            self.count[k] -= times
            if not self.count[k]:
                del self.count[k]
                self.order.remove(k)

    def give(self, pattern: Pattern, times: int) -> None:
        for k in pattern:
            if k not in self.count:
                self.order.insert(bisect_right(self.order, k), k)
                self.count[k] = 0
            self.count[k] += times

    def times(self, pattern: Pattern) -> int:
        return min(self.count[k] // pattern.count(k) for k in set(pattern))

    def below(self, most: int) -> int:
        return bisect_right(self.order, most) - 1


def best_fit_filling(left: _Lengths, capacity: int) -> Pattern:
    """The longest piece, then again and again the longest that still fits."""
    pattern, room, used = [], capacity, {}
    at = len(left.order) - 1
    while at >= 0:
        k = left.order[at]
        if k <= room and used.get(k, 0) < left.count[k]:
            pattern.append(k)
            used[k] = used.get(k, 0) + 1
            room -= k
            at = min(at, left.below(room))
        else:
            at = min(at - 1, left.below(room))
    return tuple(pattern)


def replaceable(filling: Pattern, waste: int, free: int) -> bool:
    """Whether a piece of the lengths in free (a bit set) can take the place of pieces of the filling that fit into it."""
    single = several = 0
    for k in filling:
        several |= (several | single) << k
        single |= 1 << k
    near, reached = free >> 1, 1  # sums that one of free exceeds by 1 to `reached`
    while reached < waste:
        step = min(reached, waste - reached)
        near, reached = near | near >> step, reached + step
    return bool(several & free or waste and (several | single) & near)


def fillings(left: _Lengths, capacity: int, most_waste: int, effort: list[int] | None = None) -> Iterator[Pattern]:
    """Undominated fillings around the longest piece that waste at most most_waste, the least waste first.

    Each filling that is looked at, dominated ones too, takes one from effort[0]; at 0 there are no more.
    """
    longest = left.order[-1]
    room = capacity - longest
    free = {k: left.count[k] - (k == longest) for k in left.order[: left.below(room) + 1]}
    if room == 0 or free.get(room, 0) > 0:
        yield (longest, room) if room else (longest,)
        return
    sizes = [k for k in reversed(free) if free[k] > 0]
    #: By place in sizes: the sums, as a bit set, that this length and shorter ones can make.
    reach, full = [1], (1 << (room + 1)) - 1
    for k in reversed(sizes):
        sums, more, step = reach[-1], min(free[k], room // k), 1
        while more > 0:
            sums |= sums << k * min(step, more) & full
            more, step = more - step, 2 * step
        reach.append(sums)
    reach.reverse()

    def exact(at: int, rest: int) -> Iterator[Pattern]:
        """All fillings of this sum from sizes[at:], those with the longest pieces first."""
        if rest == 0:
            yield ()
            return
        while reach[at] >> rest & 1:
            k = sizes[at]
            at += 1
            for n in range(min(free[k], rest // k), 0, -1):
                if reach[at] >> rest - n * k & 1:
                    for more in exact(at, rest - n * k):
                        yield (k,) * n + more

    some = sum(1 << k for k in sizes)
    for waste in range(min(room, most_waste) + 1):
        if reach[0] >> room - waste & 1:
            for f in exact(0, room - waste):
                if effort is not None:
                    if effort[0] <= 0:
                        return
                    effort[0] -= 1
                used_up = sum(1 << k for k in set(f) if f.count(k) >= free[k])
                if not replaceable(f, waste, some & ~used_up):
                    yield (longest, *f)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    left, plan = _Lengths(counts), []
    while left.order:
        pattern = best_fit_filling(left, capacity)
        times = left.times(pattern)
        left.take(pattern, times)
        plan.append((pattern, times))
    return plan


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[Pattern, int]]:
    """(pattern, sequences) pairs that use up the counters in as few sequences as found."""
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    most = sum(t for _, t in best)
    left = _Lengths(counts)
    plan: list[tuple[Pattern, int]] = []
    waste = 0
    effort = None if nodes is None else [nodes]

    def branches() -> Iterator[tuple[Pattern, int]]:
        # one sequence less than the incumbent leaves so much to waste
        for pattern in fillings(left, capacity, (most - 1) * capacity - total - waste, effort):
            times = left.times(pattern)
            while times:
                yield pattern, times
                times //= 2

    #: Depth first, by hand: each level holds what is still to try there.
    stack: list[Iterator[tuple[Pattern, int]]] = [branches()] if left.order else []
    while stack and most > bound and (effort is None or effort[0] > 0):
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan:
                pattern, times = plan.pop()
                left.give(pattern, times)
                waste -= (capacity - sum(pattern)) * times
            continue
        pattern, times = step
        lost = (capacity - sum(pattern)) * times
        if waste + lost > (most - 1) * capacity - total:
            continue
        left.take(pattern, times)
        plan.append(step)
        waste += lost
        if left.order:
            stack.append(branches())
        else:
            best, most = list(plan), sum(t for _, t in plan)
            stack.append(iter(()))
    return best


def placements(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of pieces, in the order of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for k in pattern:
            first = next_rank.get(k, 0)
            runs.setdefault(k, []).append((first, sequence, offset))
            next_rank[k] = first + times
            offset += k
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for k, r in runs.items()}


# --- packing -----------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    cut = materialize(pieces(docs, tokenizer_path, capacity))
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = placements(complete(histogram, capacity))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for k in np.unique(n):
            own = np.flatnonzero(n == k)
            first, start, at = where[int(k)]
            run = np.searchsorted(first, r[own], side="right") - 1
            sequence[own], offset[own] = start[run] + r[own] - first[run], at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("p", place("length", "rank")).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "p.sequence_id", "p.offset")
