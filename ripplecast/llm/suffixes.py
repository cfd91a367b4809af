"""Repeated byte strings across all documents, by suffix arrays built by grouping (linear construction without renaming).

A byte goes if a string of LENGTH bytes covers it that also starts somewhere else. Each window of
LENGTH bytes belongs to its least GRAM-byte gram by hash, the first of equals (its anchor): equal
windows have equal anchors at equal places, so they meet under the anchor's hash. Consecutive
windows of a document with one anchor make a context, the bytes that they cover together.

1. A scan gives one row a context: the anchor's hash, the context's own hash, its document and place.
2. Anchors met once end here. Where all contexts of an anchor are equal, all their windows repeat.
3. Of the other anchors each distinct context is fetched once from its text, and the contexts of
   one anchor are sorted together: they are cut into cells of CELL bytes that keep the distance
   from the anchor, each context gets an end of its own, and `suffix_array` sorts the suffixes of
   the cells. A window holds CORE whole cells, so neighbours in the suffix array that share CORE
   cells are candidates; their bytes beside these cells are compared exactly.
4. The repeated windows of each context go to all documents that hold it, and each document's
   intervals are merged.

Suffix sorting goes by Lyndon prefixes: groups of suffixes, first by symbol, are processed from
the highest down; each member points to the nearest suffix before it in a lower group, and those
pointed to, by how often, leave their group for new ones just above it, so that a group's suffixes
share their Lyndon prefix. A last pass goes up the order and, for each suffix, follows the
pointers from the one before it and appends what it meets to their groups.

No anchor's contexts meet in one task if there are more than BLOCK distinct ones: these are cut
by the windows' distance from the anchor into shorter ones, which meet under the bytes that all
their windows share, and again until few are left or one window is, so none is missed or dropped.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep all; repeated
rows are other places, so a text that occurs twice goes whole if it has LENGTH bytes; overlaps
within one text count; a null doc_id stays null; an empty table gives no rows; other columns are
not read. Contexts of one anchor are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, folder, stored

LENGTH = 200
GRAM = 64
CELL = 16
#: Distinct contexts of an anchor that are sorted in one task, and about how many are sorted together.
BLOCK = 2048
#: Windows of a text that one step hashes.
SLICE = 1 << 20
#: Bytes of contexts that are sorted together at most; BLOCK contexts have less.
TOGETHER = 1 << 20
_BITS = 12
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of substrings by running sums."""

    def __init__(self, n: int):
        self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        self.up[1:], self.down[1:] = _ODD, pow(_ODD, -1, 1 << 64)
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=out[1:])
        return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many values."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def contexts(body: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM, step: int = SLICE) -> Iterator[tuple[np.ndarray, ...]]:
    """The anchors' hashes and places, first windows and last windows of a text's contexts, in slices."""
    width, data = length - gram + 1, np.frombuffer(body, np.uint8)
    for at in range(0, len(data) - length + 1, step):
        sums = powers.sums(data[at : at + step + length - 1])
        h = (sums[gram:] - sums[:-gram]) * powers.down[: len(sums) - gram]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        first = least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), width)
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        anchors = (first[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield h[anchors].view(np.int64), anchors + at, starts + at, np.r_[starts[1:], len(first)] - 1 + at


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, c, rid, at) of the contexts of rows (rid, body): hashes of anchor and context; at packs the first
    window, the anchor's distance from it and that of the last window."""

    step = SLICE

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, digest = Powers(step + length), xxhash.xxh3_64_intdigest
        for frame in frames:
            for rid, body in zip(frame["rid"], frame["body"], strict=True):
                for a, anchors, starts, ends in contexts(body, powers, length, gram, step):
                    ahead, span = anchors - starts, ends - starts
                    c = [digest(body[s : e + length], x) for s, e, x in zip(starts.tolist(), ends.tolist(), ahead.tolist(), strict=True)]
                    yield pd.DataFrame({"a": a, "c": np.array(c, np.uint64).view(np.int64), "rid": rid, "at": (starts << 2 * _BITS) | (ahead << _BITS) | span})

    def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fewer and larger frames."""
        held, n = [], 0
        for frame in rows(frames):
            held.append(frame)
            n += len(frame)
            if n >= 50_000:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    return docs.select("rid", "body").mapInPandas(grouped, "a long, c long, rid long, at long")


def suffix_array(s: list[int]) -> list[int]:
    """The order of the suffixes of s, whose last symbol must be its least and occur once."""
    n = len(s)
    symbols = np.asarray(s)
    order = np.argsort(symbols, kind="stable")
    ranks = symbols[order]
    firsts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    sizes, starts = np.diff(np.r_[firsts, n]), np.zeros(n, np.int64)
    starts[order] = np.repeat(firsts, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, at, group, size, before = order.tolist(), place.tolist(), starts.tolist(), dict(zip(firsts.tolist(), sizes.tolist(), strict=True)), [-1] * n
    end = n - 1
    while end >= 0:
        start = group[sa[end]]
        pointed: dict[int, int] = {}
        for i in sorted(sa[start : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start - 1
        leaving: dict[int, list[tuple[int, int]]] = {}
        for p, times in pointed.items():
            leaving.setdefault(group[p], []).append((times, p))
        for old, moved in leaving.items():
            moved.sort(reverse=True)
            top = old + size[old]
            size[old] -= len(moved)
            i = 0
            while i < len(moved):
                j = i
                while j < len(moved) and moved[j][0] == moved[i][0]:
                    j += 1
                new = top - (j - i)
                for to, (_, p) in enumerate(moved[i:j], new):
                    here, other = at[p], sa[to]
                    sa[here], at[other], sa[to], at[p], group[p] = other, here, p, to, new
                size[new], top, i = j - i, new, j
    out, free = [n - 1] * n, {g: g for g in size}
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = before[p]
    return out


def repeated(texts: list[bytes], ahead: list[int], powers: Powers, length: int = LENGTH, cell: int = CELL) -> np.ndarray:
    """(text, start) of each window of the texts that is equal to another one at the same distance from its anchor.

    ahead: the anchor's place in each text.
    """
    core, known, symbols, where, owner = (length - cell + 1) // cell, {}, [], [], []
    bases = np.cumsum([0, *map(len, texts)])
    for i, (text, x) in enumerate(zip(texts, ahead, strict=True)):
        cells = range(x % cell, len(text) - cell + 1, cell)
        symbols += [len(texts) + known.setdefault(text[p : p + cell], len(known)) for p in cells]
        symbols.append(len(texts) - 1 - i)
        where += [int(bases[i]) + p for p in cells]
        where.append(-1)
        owner += [i] * (len(cells) + 1)
    sa = np.array(suffix_array(symbols))
    padded = np.r_[np.array(symbols), -1 - np.arange(core)]
    same = np.ones(len(sa) - 1, bool)
    for t in range(core):
        same &= padded[sa[:-1] + t] == padded[sa[1:] + t]
    groups = np.cumsum(np.r_[True, ~same]) - 1
    several = np.bincount(groups)[groups] > 1
    sa, groups = sa[several], groups[several]
    cells, own = np.array(where)[sa], np.array(owner)[sa]
    # the windows whose first whole cell this is, by the bytes left of it
    left = np.arange(cell)
    window = cells[:, None] - left
    valid = (window >= bases[own][:, None]) & (window + length <= bases[own + 1][:, None])
    window, group, left, own = window[valid], np.broadcast_to(groups[:, None], valid.shape)[valid], np.broadcast_to(left, valid.shape)[valid], np.broadcast_to(own[:, None], valid.shape)[valid]
    if not len(window):
        return np.empty((0, 2), np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sums = powers.sums(data)
    key = (sums[window + length] - sums[window]) * powers.down[window] + group.astype(np.uint64) * _MIX
    order = np.argsort(key)
    key, window, group, left, own = key[order], window[order], group[order], left[order], own[order]
    near = np.flatnonzero(key[1:] == key[:-1])
    beside = np.arange(length - core * cell)
    at = lambda i: window[i][:, None] + np.where(beside < left[i][:, None], beside, beside + core * cell)
    equal = (group[near] == group[near + 1]) & (left[near] == left[near + 1])
    for part in np.array_split(np.arange(len(near)), len(near) // 100_000 + 1):
        equal[part] &= (data[at(near[part])] == data[at(near[part] + 1)]).all(axis=1)
    hit = np.zeros(len(window), bool)
    hit[near[equal]] = hit[near[equal] + 1] = True
    for i in near[~equal]:  # equal hashes of unlike windows: all of this hash are compared
        among = np.flatnonzero(key == key[i])
        found: dict[bytes, list[int]] = {}
        for j in among:
            found.setdefault(data[window[j] : window[j] + length].tobytes(), []).append(j)
        hit[among] = False
        for equals in found.values():
            hit[equals] = len(equals) > 1
    return np.stack([own[hit], window[hit] - bases[own[hit]]], axis=1)


def sorted_contexts(rows: DataFrame, length: int, cell: int) -> DataFrame:
    """(a, c, runs) of rows (key, a, c, n, base, ahead, text) that meet under key: first and last windows, in turn, of the
    repeated ones; none for contexts that are known to repeat (n > 1)."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held = Powers(TOGETHER), None

        def runs(rows: pd.DataFrame) -> pd.DataFrame:
            found = repeated(rows["text"].tolist(), rows["ahead"].tolist(), powers, length, cell)
            found = found[(rows["n"].to_numpy() == 1)[found[:, 0]]]
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            new = np.flatnonzero(np.r_[True, (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 1)]) if len(found) else np.empty(0, int)
            last = np.r_[new[1:], len(found)] - 1 if len(found) else new
            own, base = found[new, 0], rows["base"].to_numpy()
            out: dict[int, list[int]] = {}
            for i, s, e in zip(own.tolist(), found[new, 1].tolist(), found[last, 1].tolist(), strict=True):
                out.setdefault(i, []).extend((s + int(base[i]), e + int(base[i])))
            which = list(out)
            return pd.DataFrame({"a": rows["a"].to_numpy()[which], "c": rows["c"].to_numpy()[which], "runs": list(out.values())}) if out else pd.DataFrame(columns=["a", "c", "runs"])

        def parts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Whole keys, about BLOCK rows at a time and not more bytes than powers."""
            ends = np.r_[np.flatnonzero(np.diff(rows["key"].to_numpy()) != 0) + 1, len(rows)]
            sizes = np.cumsum(rows["text"].map(len).to_numpy())
            at = 0
            while at < len(rows):
                fit = ends[(ends > at) & ((ends <= at + BLOCK) & (sizes[ends - 1] - (sizes[at - 1] if at else 0) < TOGETHER))]
                to = fit[-1] if len(fit) else ends[ends > at][0]
                yield runs(rows.iloc[at:to].reset_index(drop=True))
                at = to

        for frame in frames:
            if not len(frame):
                continue
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            cut = np.flatnonzero(held["key"].to_numpy() != held["key"].iloc[-1])
            if len(cut) and len(held) >= BLOCK:
                yield from parts(held.iloc[: cut[-1] + 1].reset_index(drop=True))
                held = held.iloc[cut[-1] + 1 :].reset_index(drop=True)
        if held is not None:
            yield from parts(held)

    rows = rows.select("key", "a", "c", "n", "base", "ahead", "text").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(search, "a long, c long, runs array<int>")


def fetched(hard: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The contexts (a, c, n, d, base, ahead, span, text) of hard (a, c, n, d, rid, at), cut from the texts of docs."""

    names = ["a", "c", "n", "d", "base", "ahead", "span", "text"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, out, held = (1 << _BITS) - 1, [], 0
        for frame in frames:
            for body, *columns in zip(frame["body"], *(frame[x] for x in "a c n d at".split()), strict=True):
                for a, c, n, d, at in zip(*(x.tolist() for x in columns), strict=True):
                    start, span = at >> 2 * _BITS, at & low
                    out.append((a, c, n, d, 0, at >> _BITS & low, span, body[start : start + span + length]))
                    held += span + length
                    if held >= 4_000_000:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        yield pd.DataFrame(out, columns=names)

    wanted = hard.groupBy("rid").agg(F.collect_list(F.struct("a", "c", "n", "d", "at")).alias("rows"))
    return wanted.join(docs.select("rid", "body"), "rid").select("body", "rows.a", "rows.c", "rows.n", "rows.d", "rows.at").mapInPandas(cut, "a long, c long, n long, d long, base int, ahead int, span int, text binary")


def narrowed(rows: DataFrame, width: int, length: int, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cuts contexts (a, c, n, base, ahead, span, text) by the windows' distance from the anchor, width distances a piece.

    Returns (a, c, runs) of pieces that occur again as they are, the distinct pieces under the bytes that all their
    windows share (key) if some but not more than BLOCK meet there, and those of which more do.
    """
    far, near = F.col("ahead").cast("int"), F.col("ahead") - F.col("span")
    pieces = rows.select("*", F.explode(F.sequence(F.floor(near / width).cast("int"), F.floor(far / width).cast("int"))).alias("q"))
    most, fewest = F.least(F.col("q") * width + width - 1, far), F.greatest(F.col("q") * width, near)
    core = F.substring("text", F.col("ahead") - F.col("q") * width + 1, F.lit(length - width + 1))
    pieces = pieces.select("a", "c", "n", "q", core.alias("core"), (F.col("base") + F.col("ahead") - most).cast("int").alias("base"), most.cast("int").alias("ahead"), (most - fewest).cast("int").alias("span"),
                           F.substring("text", F.col("ahead") - most + 1, most - fewest + length).alias("text"))
    pieces = keep(pieces, f"pieces-{width}")
    alike = ["a", "q", "ahead", "span", "text"]
    same = pieces.groupBy(*alike).agg(F.sum("n").alias("many"), F.min(F.struct("c", "base", "core")).alias("one"))
    done = pieces.filter("n = 1").join(same.filter("many > 1").select(*alike), alike).select("a", "c", F.array("base", F.col("base") + F.col("span")).alias("runs"))
    ones = same.select("a", "one.c", F.col("many").alias("n"), "one.base", "ahead", "span", "text", "q", "one.core")
    sizes = ones.groupBy("a", "q", "core").agg(F.count("*").alias("met")).filter("met > 1")
    ones = keep(ones.join(sizes, ["a", "q", "core"]).withColumn("key", F.xxhash64("a", "q", "core")), f"ones-{width}")
    return done, ones.filter(F.col("met") <= BLOCK), ones.filter(F.col("met") > BLOCK).select("a", "c", "n", "base", "ahead", "span", "text")


def covers(hard: DataFrame, docs: DataFrame, length: int, gram: int, cell: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(a, c, runs): the repeated windows of distinct contexts (a, c, n, d, rid, at) whose anchors have d of them."""
    cut = keep(fetched(hard, docs, length), "cut")
    out = [hard.filter("n > 1").select("a", "c", F.array(F.lit(0), F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")).alias("runs"))]
    out.append(sorted_contexts(cut.filter(F.col("d") <= BLOCK).withColumn("key", F.col("a")), length, cell))
    large, width = cut.filter(F.col("d") > BLOCK).drop("d"), length - gram + 1
    while width > 1 and not large.isEmpty():
        width = -(-width // 8)
        done, few, large = narrowed(large, width, length, keep)
        out += [done, sorted_contexts(few, length, cell)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(rid, spans) of those rows (rid, body) in which a window is repeated: arrays of first byte and end, overlapping each other."""
    spark, work = docs.sparkSession, f"{folder(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    rows = keep(scan(docs, length, gram), "rows")
    # written, so that a join with a frequent anchor's rows can be split
    alive = keep(rows.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("hard")).filter("n > 1").select("a", "hard"), "alive")
    members = keep(rows.join(alive, "a"), "members")
    delete(spark, f"{work}/rows")
    each = members.filter("hard").groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    each = keep(each.select("a", "c", "n", "one.rid", "one.at"), "each")
    hard = each.join(keep(each.groupBy("a").agg(F.count("*").alias("d")), "sizes"), "a")
    found = keep(covers(hard, docs, length, gram, cell, keep), "found")
    start = F.shiftright("at", 2 * _BITS)
    last = start + F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1))
    whole = members.filter(~F.col("hard")).select("rid", start.alias("first"), (last + length).alias("end"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(F.get("runs", i).alias("f"), F.get("runs", i + 1).alias("t")))
    part = members.filter("hard").join(found.select("a", "c", F.explode(pairs).alias("r")), ["a", "c"])
    part = part.select("rid", (start + F.col("r.f")).alias("first"), (start + F.col("r.t") + length).alias("end"))
    spans = stored(whole.unionByName(part).groupBy("rid").agg(F.collect_list(F.array("first", "end")).alias("spans")))
    delete(spark, work)
    return spans


def kept(body: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the sha256 of the rest; spans: (first, end), in any order."""
    digest, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
    for first, to in spans[np.argsort(spans[:, 0], kind="stable")].tolist() if len(spans) else ():
        if first > end:
            digest.update(body[at:first])
            runs, removed, end = runs + 1, removed + to - first, to
        elif to > end:
            removed, end = removed + to - end, to
        at = end
    digest.update(body[at:])
    return removed, runs, digest.hexdigest()


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), body.alias("body")))
    spans = intervals(rows, length, gram, cell)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def judged(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        none = np.empty((0, 2), np.int64)
        out = [kept(b, none if s is None else np.array([*s], np.int64).reshape(-1, 2)) for b, s in zip(bodies, spans, strict=True)]
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(spans, "rid", "left").select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), judged("body", "spans").alias("k"))
    return joined.select("doc_id", "n_bytes", "k.*")
