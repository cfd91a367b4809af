"""Near-duplicate documents: SimHash fingerprints linked by covering locality-sensitive hashing.

A fingerprint takes 64 bits by majority over the hashes of a text's shingles. Two
fingerprints link when they differ in at most RADIUS bits. Candidates come from
2**(RADIUS+1) - 1 bit masks built from parities: each bit position i gets a vector
m(i) over GF(2) with RADIUS+1 elements, and the mask of a nonzero vector v keeps the
positions with <m(i), v> = 1. At most RADIUS differing positions span at most RADIUS
dimensions, so some v is orthogonal to all of them and the two fingerprints agree on
all that this mask keeps: no pair within the radius is missed in every table.

Defined results: a null or empty text and one of white space have fingerprint zero and
link as any other; repeated rows share their fingerprint and component; a null doc_id
takes part, but never names a component that has a doc_id; empty tables give no rows;
other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, materialize, stored

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members of a bucket that one step compares; larger buckets are masked again, then cut into blocks of this size.
BLOCK = 2048
_STEP = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle; of the whole sequence if it has fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(k)))), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit majority fingerprint as a signed number."""
    hashes = shingle_hashes(lower_words(text), k)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def covering_masks(radius: int = RADIUS, positions: Sequence[int] = range(64)) -> list[int]:
    """The masks over some bit positions, as signed numbers."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(len(positions))]
    return [signed(sum(1 << p for p, m in zip(positions, vectors) if (m & v).bit_count() % 2)) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text_col: str = "text", k: int = SHINGLE) -> Column:
    """A column: the fingerprint of a text."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return fp(F.col(text_col))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values within the radius."""
    edges, left = [], values.view(np.uint64)  # of signed numbers, bitwise_count takes the absolute value
    while len(left) > 1:
        tree, left = [left[0]], left[1:]
        while tree and len(left):
            node = tree.pop()
            near = np.bitwise_count(left ^ node) <= radius
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(a), int(b)) for a, b in zip(np.full(len(found), node).view(np.int64), found.view(np.int64), strict=True)]
                tree += list(found)
    return edges


def _links(radius: int):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; a bucket that a batch cuts is carried into the next one."""
        rest: tuple[np.ndarray, np.ndarray] | None = None

        def edges_of(bucket: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, np.any(bucket[1:] != bucket[:-1], axis=1)]) if len(bucket) else np.empty(0, int)
            ends = np.r_[starts[1:], len(bucket)] if len(starts) else starts
            out = [e for s, t in zip(starts, ends, strict=True) if t - s > 1 for e in forest(np.unique(fp[s:t]), radius)]
            return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

        for frame in frames:
            bucket, fp = frame[["mask", "kept", "i", "j"]].to_numpy(np.int64), frame["fp"].to_numpy(np.int64)
            if rest is not None:
                bucket, fp = np.concatenate([rest[0], bucket]), np.concatenate([rest[1], fp])
            if not len(bucket):
                continue
            last = np.flatnonzero(np.any(bucket != bucket[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            rest = (bucket[cut:], fp[cut:])
            yield edges_of(bucket[:cut], fp[:cut])
        if rest is not None:
            yield edges_of(*rest)

    return verify


def candidate_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (src, dst) whose components are those of all pairs of distinct fp within the radius.

    Each bucket gives a spanning forest of its members, at most one link less than it has
    members. In a bucket over BLOCK members, all of which agree on what its mask keeps, the other
    bits are covered by masks of their own in the same way, so it falls into smaller ones that
    miss no pair either. What is still over BLOCK members is cut into blocks by hash, and each
    pair of blocks is compared by itself, so no task holds more than two blocks.
    """
    masks = covering_masks(radius)
    finer = [[signed((m | n) % (1 << 64)) for n in covering_masks(radius, [b for b in range(64) if not m >> b & 1])] for m in masks]
    kept = lambda own: F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for i, m in enumerate(own)])
    members = lambda b: b.select("fp", "b.mask", "b.kept")
    rows = shared(members(nodes.select("fp", F.explode(kept(masks)).alias("b"))))
    inner = reduce(lambda c, i: c.when(F.col("mask") == i, F.array(*[F.struct(F.lit((i + 1) * len(masks) + j).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for j, m in enumerate(finer[i])])), range(1, len(masks)), F.when(F.col("mask") == 0, F.array(*[F.struct(F.lit(len(masks) + j).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for j, m in enumerate(finer[0])])))
    again = shared(members(rows.filter(F.col("n") > BLOCK).select("fp", F.explode(inner).alias("b"))))
    small = rows.filter(F.col("n") <= BLOCK).unionByName(again.filter(F.col("n") <= BLOCK))
    small = small.select("mask", "kept", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp").repartition("mask", "kept").sortWithinPartitions("mask", "kept")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    other = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    large = again.filter(F.col("n") > BLOCK).withColumn("own", own).select("mask", "kept", "fp", "own", F.explode(F.filter(other, lambda p: p["i"] < p["j"])).alias("p"))
    large = large.select("mask", "kept", "p.i", "p.j", "fp").repartition("mask", "kept", "i", "j").sortWithinPartitions("mask", "kept", "i", "j")
    verify, schema = _links(radius), "src long, dst long"
    return small.mapInPandas(verify, schema).union(large.mapInPandas(verify, schema)).distinct()


def shared(rows: DataFrame) -> DataFrame:
    """rows of (fp, mask, kept) in buckets of two or more, with the bucket's size n."""
    sizes = rows.groupBy("mask", "kept").agg(F.count("*").alias("n")).filter("n > 1")
    return materialize(rows.join(sizes, ["mask", "kept"]))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each component, by alternating star contraction.

    A large-star step links every larger neighbour of a node to its smallest neighbour, a
    small-star step every smaller one; both are a grouped minimum and a join. Each round is
    written to the checkpoint folder. The rounds grow with the logarithm of the graph's size.
    """
    edges = materialize(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v")
        edges = materialize(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, fp, component_id, keep_rid) for each row, as components gives them."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), fingerprint_of(text_col, k).alias("fp"))
    return components(materialize(rows), radius)


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(rid, doc_id, fp, component_id, keep_rid) of rows of (rid, doc_id, fp); component_id is the least
    doc_id reachable, keep_rid the row number to keep of the component (least doc_id, then first row)."""
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")
    nodes = rows.groupBy("fp").agg(F.min(first).alias("first"))
    return grouped(rows, nodes, candidate_links(nodes.select("fp"), radius))


def grouped(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """As components, given its nodes (fp, first) and the links (src, dst) between them."""
    roots = connected(links)
    members = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = roots.select(F.col("node").alias("fp"), "root").union(roots.select("root", "root").distinct())
    least = members.join(linked.select("fp"), "fp", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    found = members.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return rows.join(found, "fp", "left").select("rid", rows["doc_id"], "fp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep_rid"))


def keep_one(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """The rows of docs without all but one row of each component, in docs' own columns."""
    packed = stored(docs.select(F.monotonically_increasing_id().alias("rid"), fingerprint_of("text", k).alias("fp"), F.struct("*").alias("row")))
    found = components(packed.select("rid", F.col("row.doc_id").alias("doc_id"), "fp"), radius)
    kept = found.filter(F.col("rid") == F.col("keep_rid")).select("rid")
    return packed.join(kept, "rid", "left_semi").select("row.*")
