"""Ranks within groups of any size: counts by (group, block) and ranks within a block, no group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unique integer ids of one block are at most so many rows.
BLOCK_IDS = 1 << 16


def id_block(id_col: str) -> Column:
    return F.floor(F.col(id_col) / BLOCK_IDS).cast("long")


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "place") -> DataFrame:
    """rows with their 1-based rank by order within keys; ties of order get ranks of their own in any order.

    block must not fall as order rises. A task ranks one (keys, block); only the counts, one row a
    block, are summed up along a whole group. Null keys form a group, null blocks come first.
    """
    placed = rows.withColumn("_block", block)
    nth = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    counts = placed.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_at"), before.alias("_before"))
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = placed.withColumn("_nth", nth).join(starts, same)
    return out.select(*rows.columns, (F.col("_nth") + F.col("_before")).alias(name))
