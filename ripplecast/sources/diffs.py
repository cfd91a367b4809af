"""Unified diffs as rows: one for each changed line of code, with its line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What counts as a changed line of code, and in which files.
SUFFIXES = (".java", ".xml")
SKIPPED = (".git", "src/test")
NOT_CODE = "^(\\*|//|import )"
HUNK = "^@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@"


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff, text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff"), F.col("value").alias("text"))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(diff, path, op, line_no, content) from (diff, text).

    Lines are numbered within their hunk by running counts: added ones by the new file's lines,
    removed ones by the old file's. Blank lines, comments and imports are left out, and so are
    other files than SUFFIXES and paths with SKIPPED parts. A null text gives no rows.
    """
    lines = diffs.select("diff", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    in_order = Window.partitionBy("diff").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col("line").rlike(HUNK)
    lines = lines.select(
        "diff", "pos", "line",
        F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", "^\\+\\+\\+ ([^\\t]*)", 1), "^b/", "")), True).over(in_order).alias("path"),
        F.last(F.when(F.col("line").startswith("diff ") | F.col("line").startswith("--- "), -1).when(is_header, F.col("pos")), True).over(in_order).alias("hunk"),
        F.last(F.when(is_header, F.regexp_extract("line", HUNK, 1).cast("int")), True).over(in_order).alias("old_start"),
        F.last(F.when(is_header, F.regexp_extract("line", HUNK, 2).cast("int")), True).over(in_order).alias("new_start"),
    ).filter("hunk >= 0 AND pos > hunk")
    op = F.substring("line", 1, 1)
    in_hunk = Window.partitionBy("diff", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda other: F.sum(F.when(~op.isin(other, "\\"), 1).otherwise(0)).over(in_hunk) - 1
    numbered = lines.select("diff", "path", op.alias("op"), (F.when(op == "+", F.col("new_start") + count("-")).otherwise(F.col("old_start") + count("+"))).cast("int").alias("line_no"), F.substring("line", 2, 1 << 30).alias("content"))
    code = F.trim("content")
    wanted = numbered.filter(F.col("op").isin("+", "-") & (code != "") & ~code.rlike(NOT_CODE))
    suffix = [F.col("path").endswith(s) for s in SUFFIXES]
    return wanted.filter((suffix[0] | suffix[1]) & ~F.col("path").contains(SKIPPED[0]) & ~F.col("path").contains(SKIPPED[1]))
