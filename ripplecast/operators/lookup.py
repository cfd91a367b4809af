"""Lookups by key with preference, and merges of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; order must end in something unique."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def merge_versions(base: DataFrame, increment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without deleted rows and without the keys that increment has, and all of increment."""
    alive = base.filter(F.col("change_type").isNull() | (F.col("change_type") != "DELETED"))
    return alive.join(increment.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns).unionByName(increment)


def resolve_overload(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """For each call (call_id, class_id, method_name, parameters): the method of that name with the same
    parameters, else the first of the name. Two equi joins, so a popular name is no hot key of the exact one."""
    names = ["class_id", "method_name"]
    exact = methods.groupBy(*names, "parameters").agg(F.min("method_id").alias("exact_id"))
    any_ = methods.groupBy(*names).agg(F.min("method_id").alias("first_id"))
    found = calls.join(exact, [*names, "parameters"], "left").join(any_, names, "left")
    return found.select("call_id", F.coalesce("exact_id", "first_id").alias("method_id"), F.col("exact_id").isNotNull().alias("is_exact"))


def lines_in_ranges(lines: DataFrame, ranges: DataFrame, key: str = "class_id", width: int = 64) -> DataFrame:
    """Inner range join of (key, line_no) with (key, start_line, end_line), by key and line block.

    A range is listed under each block of `width` lines that it touches, so a class with many
    lines and methods is spread over its blocks and only near pairs meet.
    """
    blocks = F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))
    listed = ranges.withColumn("_block", F.explode(blocks))
    at = lines.withColumn("_block", F.floor(F.col("line_no") / width))
    return at.join(listed, [key, "_block"]).filter("line_no BETWEEN start_line AND end_line").drop("_block")


def upsert(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the keys of changes replaced."""
    return rows.join(changes.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns).unionByName(changes)


def insert_absent(rows: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of fresh whose key rows lacks, one a key."""
    one = first_per_key(fresh, keys, [F.col(c) for c in fresh.columns])
    return one.join(rows.select(*keys), list(keys), "left_anti").select(*fresh.columns)


def prefix_join(asked: DataFrame, entries: DataFrame, scope: str, prefix: str, value: str) -> DataFrame:
    """asked and entries of one scope where the entry's value starts with the asked prefix, by equi joins.

    An entry is listed under its prefixes of those lengths that are asked for in its scope, so it has as many rows
    as there are different lengths, and no pair is compared that does not match. Empty prefixes match nothing.
    """
    return asked.join(listed_by_prefix(asked, entries, scope, prefix, value), [scope, prefix])


def listed_by_prefix(asked: DataFrame, entries: DataFrame, scope: str, prefix: str, value: str) -> DataFrame:
    """entries, each once for each length of prefix that is asked for in its scope, with that prefix of its value."""
    lengths = asked.filter(F.length(prefix) > 0).groupBy(scope).agg(F.collect_set(F.length(prefix)).alias("_lengths"))
    listed = entries.join(lengths, scope).withColumn("_n", F.explode("_lengths")).filter(F.length(value) >= F.col("_n")).withColumn(prefix, F.substring(F.col(value), F.lit(1), F.col("_n")))
    return listed.drop("_lengths", "_n")


def prefix_counts(asked: DataFrame, entries: DataFrame, scope: str, prefix: str, value: str) -> DataFrame:
    """asked with the number of entries that prefix_join finds for each row, and the least of their values.

    Entries are counted by prefix before they meet a question, so no pair is made, however many entries a short prefix
    has. Rows of asked without a match are left out.
    """
    counts = listed_by_prefix(asked, entries, scope, prefix, value).groupBy(scope, prefix).agg(F.count("*").alias("n"), F.min(value).alias(value))
    return asked.join(counts, [scope, prefix])


#: Rows of one key that a task of split_join holds at once.
KEY_BLOCK = 512


def split_join(few: DataFrame, many: DataFrame, keys: Sequence[str], row: str, block: int = KEY_BLOCK) -> DataFrame:
    """Inner equi join of two tables where a key may have many rows in both, so that no task holds or makes all pairs of a key.

    The rows of a key in many are dealt over parts of about `block` by a hash of `row`; a row of few is listed in each.
    """
    sizes = many.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("long").alias("_parts"))
    dealt = many.join(sizes, list(keys)).withColumn("_part", F.pmod(F.xxhash64(row), F.col("_parts"))).drop("_parts")
    listed = few.join(sizes, list(keys)).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return listed.join(dealt, [*keys, "_part"]).drop("_part")


def suffix_join(paths: DataFrame, files: DataFrame, path: str, file: str) -> DataFrame:
    """paths and files where the file's name ends in the path, at a slash, by an equi join.

    Both sides are cut at slashes; a file is listed under its last segments for those numbers of segments that some
    path has, of which there are few, whatever their lengths.
    """
    counts = [r[0] for r in paths.select(F.size(F.split(path, "/"))).distinct().collect()]
    ending = F.explode(F.expr(f"transform(filter(array({', '.join(map(str, counts))}), n -> n <= size(split({file}, '/'))), n -> array_join(slice(split({file}, '/'), -n, n), '/'))"))
    return paths.join(files.withColumn(path, ending), path) if counts else paths.join(files.withColumn(path, F.col(file)).limit(0), path)
