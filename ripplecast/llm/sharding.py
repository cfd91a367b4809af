"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Rows get their global number in the order of (doc_id, text_crc32, size), so the result does
not depend on how the table is laid out in files. The number is split into a quotient and a
remainder by a side of about the square root of the row count; ROUNDS rounds add a keyed hash
of one half to the other, modulo the other's size. This permutes a domain that is larger
than the row count by less than one side; a number that leaves the range is permuted again
(cycle walking) until it is back. Shard and slot are the remainder and quotient of the
permuted number by the shard count, so shards differ by at most one row (law `rows`), and
anyone who knows the row count and the key can compute both for any row number.

Defined results: a null text has size 8 and crc32 0; a null doc_id sorts first; repeated rows
get numbers of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 6
KEY = 20240131
SHARDS = 24
#: Walks in one expression; 16 leave the range with a chance of rows ** -8, and then the query fails loudly.
WALKS = 16


def feistel(number: Column, rows: int, key: int = KEY) -> Column:
    """One pass of the permutation of 0 .. side * ceil(rows / side) - 1."""
    side = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    other = max(1, -(-rows // side))
    state = F.struct((number % side).alias("a"), F.floor(number / side).cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        # even rounds change a by a hash of b, odd rounds b by a hash of a
        even = r % 2 == 0
        mixed = F.xxhash64(F.lit(key).cast("long"), r.cast("long"), F.when(even, s["b"]).otherwise(s["a"]))
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(mixed, F.lit(side)), F.lit(side))).otherwise(s["a"]).cast("long").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(mixed, F.lit(other)), F.lit(other))).cast("long").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: s["b"] * side + s["a"])


def permute(number: Column, rows: int, key: int = KEY) -> Column:
    """The permutation of 0 .. rows - 1."""
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), feistel(number, rows, key), lambda x, _: F.when(x < rows, x).otherwise(feistel(x, rows, key)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("cycle walking did not return; raise WALKS")).cast("long"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, permuted, shard and slot of each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    # written once: range bounds are sampled, and both the counts and the numbers must see the same ones
    placed = materialize(small.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("mid")))
    placed = placed.select("*", F.shiftright("mid", 33).alias("part"), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = placed.count()
    numbered = placed.join(F.broadcast(before), "part").select("doc_id", "size", "text_crc32", (F.col("before") + F.col("nth")).alias("row_number"))
    moved = numbered.withColumn("permuted", permute(F.col("row_number"), rows, key))
    return moved.select("*", (F.col("permuted") % shards).cast("int").alias("shard"), F.floor(F.col("permuted") / shards).cast("long").alias("slot"))
