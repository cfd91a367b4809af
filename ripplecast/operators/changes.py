"""Change detection between two versions from diffs and line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import lines_in_ranges


def file_class(added: Column, removed: Column) -> Column:
    """ADDED for a file with added lines only, DELETED with removed ones only, else MODIFIED; null without any."""
    return F.when((added > 0) & (removed == 0), "ADDED").when((added == 0) & (removed > 0), "DELETED").when(added > 0, "MODIFIED")


def file_changes(diff: DataFrame, key: str = "class_id") -> DataFrame:
    counts = diff.groupBy(key).agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
    return counts.withColumn("kind", file_class(F.col("added"), F.col("removed"))).filter("kind IS NOT NULL")


def mark_classes(classes: DataFrame, changes: DataFrame) -> DataFrame:
    """change_type set from the file's kind where it was UNCHANGED; other marks stay."""
    rows = classes.join(changes.select("class_id", "kind"), "class_id", "left")
    return rows.withColumn("change_type", F.when((F.col("change_type") == "UNCHANGED") & F.col("kind").isNotNull(), F.col("kind")).otherwise(F.col("change_type"))).drop("kind")


def removed_methods(diff: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods of the old version all of whose lines are removed: (method_id)."""
    lines = diff.filter("op = '-'").select("class_id", "line_no").distinct()
    hits = lines_in_ranges(lines, methods.select("class_id", "method_id", "start_line", "end_line"))
    return hits.groupBy("method_id", "start_line", "end_line").agg(F.count("*").alias("n")).filter("n = end_line - start_line + 1").select("method_id")


def touched_methods(diff: DataFrame, methods: DataFrame, op: str = "+") -> DataFrame:
    """Methods with at least one line of that kind: (method_id)."""
    lines = diff.filter(F.col("op") == op).select("class_id", "line_no").distinct()
    return lines_in_ranges(lines, methods.select("class_id", "method_id", "start_line", "end_line")).select("method_id").distinct()


def method_changes(diff: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(method_id, kind) of the new version's touched methods: MODIFIED if the old version has the
    class, name and parameter types, else ADDED."""
    keys = ["class_id", "method_name", "parameters"]
    known = old.select(*keys).distinct().withColumn("known", F.lit(True))
    touched = new.join(touched_methods(diff, new), "method_id", "left_semi")
    return touched.join(known, keys, "left").select("method_id", F.when(F.col("known"), "MODIFIED").otherwise("ADDED").alias("kind"))


def accessors(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(field_id, method_id): a field's getters and setters by name in its class."""
    names = F.explode(F.array(*[F.concat(F.lit(p), F.initcap("field_name")) for p in ("get", "set", "is")]))
    wanted = fields.select("field_id", "class_id", names.alias("accessor"))
    own = methods.select("class_id", F.col("method_name").alias("accessor"), "method_id")
    return wanted.join(own, ["class_id", "accessor"]).select("field_id", "method_id")
