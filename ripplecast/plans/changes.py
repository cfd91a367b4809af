"""Queries on change detection (D*, P06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import changes, lookup
from ..registry import query
from .projections import ENDINGS

KINDS = """SELECT class_id, added, removed, CASE WHEN added > 0 AND removed = 0 THEN 'ADDED' WHEN added = 0 AND removed > 0 THEN 'DELETED' ELSE 'MODIFIED' END AS kind
  FROM (SELECT class_id, count(*) FILTER (op = '+') AS added, count(*) FILTER (op = '-') AS removed FROM {diff_f} GROUP BY class_id) x WHERE added > 0 OR removed > 0"""
HIT = "SELECT DISTINCT m.method_id FROM (SELECT DISTINCT class_id, line_no FROM {diff_f} WHERE op = '%s') l JOIN {method_v} m ON l.class_id = m.class_id AND l.line_no BETWEEN m.start_line AND m.end_line"
GONE = """SELECT m.method_id FROM {method_f} m JOIN (SELECT DISTINCT class_id, line_no FROM {diff_f} WHERE op = '-') l ON l.class_id = m.class_id AND l.line_no BETWEEN m.start_line AND m.end_line
  GROUP BY m.method_id, m.start_line, m.end_line HAVING count(*) = m.end_line - m.start_line + 1"""
CHANGED = f"""SELECT v.method_id, CASE WHEN b.class_id IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS kind FROM {{method_v}} v JOIN ({HIT % '+'}) h ON v.method_id = h.method_id AND v.project_id = 1
  LEFT JOIN (SELECT DISTINCT class_id, method_name, parameters FROM {{method_f}}) b ON v.class_id = b.class_id AND v.method_name = b.method_name AND v.parameters = b.parameters"""


@query("D01_file_kind", KINDS)
def d01(f: Facts) -> DataFrame:
    return changes.file_changes(f.diff_f)


@query("D02_class_marks", f"SELECT c.class_id, CASE WHEN c.change_type = 'UNCHANGED' AND k.kind IS NOT NULL THEN k.kind ELSE c.change_type END AS change_type FROM {{class_f}} c LEFT JOIN ({KINDS}) k ON c.class_id = k.class_id")
def d02(f: Facts) -> DataFrame:
    return changes.mark_classes(f.class_f, changes.file_changes(f.diff_f)).select("class_id", "change_type")


@query("D03_deleted_methods", GONE)
def d03(f: Facts) -> DataFrame:
    return changes.removed_methods(f.diff_f, f.method_f)


@query("D04_method_changes", CHANGED)
def d04(f: Facts) -> DataFrame:
    return changes.method_changes(f.diff_f, f.method_f, f.method_v.filter("project_id = 1"))


BY_LINE = f"SELECT method_id, 'ADDED' AS kind FROM ({HIT % '+'}) a WHERE method_id IN (SELECT method_id FROM {{method_v}} WHERE project_id = 1) UNION ALL SELECT method_id, 'DELETED' FROM ({HIT % '-'}) b WHERE method_id IN (SELECT method_id FROM {{method_v}} WHERE project_id = 0)"


@query("D05_line_fallback", BY_LINE)
def d05(f: Facts) -> DataFrame:
    added = changes.touched_methods(f.diff_f, f.method_v.filter("project_id = 1"), "+").withColumn("kind", F.lit("ADDED"))
    return added.union(changes.touched_methods(f.diff_f, f.method_v.filter("project_id = 0"), "-").withColumn("kind", F.lit("DELETED")))


@query("D06_statement_hits", "SELECT DISTINCT s.stmt_id FROM {stmt_f} s JOIN (SELECT DISTINCT class_id, line_no FROM {diff_f} WHERE op <> ' ') l ON s.class_id = l.class_id AND l.line_no BETWEEN s.start_line AND s.start_line + 2")
def d06(f: Facts) -> DataFrame:
    lines = f.diff_f.filter("op <> ' '").select("class_id", "line_no").distinct()
    ranges = f.stmt_f.select("class_id", "stmt_id", "start_line", (F.col("start_line") + 2).alias("end_line"))
    return lookup.lines_in_ranges(lines, ranges).select("stmt_id").distinct()


@query("D07_accessors", "SELECT p.p_partkey AS field_id, m.method_id FROM {part} p JOIN {method_f} m ON m.class_id = p.p_partkey % (SELECT count(*) FROM {supplier}) AND m.method_name IN ('getItem' || CAST(p_size % 3 AS STRING), 'setItem' || CAST(p_size % 3 AS STRING))")
def d07(f: Facts) -> DataFrame:
    classes = f.method_f.select(F.col("method_id").alias("p_partkey"), "class_id")
    fields = f.part.join(classes, "p_partkey").select(F.col("p_partkey").alias("field_id"), "class_id", F.concat(F.lit("item"), (F.col("p_size") % 3).cast("string")).alias("field_name"))
    return changes.accessors(fields, f.method_f)


@query("D08_duplicate_analysis", "SELECT git_url, tag_old, tag_new, count(*) > 1 AS repeated FROM {task_f} GROUP BY git_url, tag_old, tag_new")
def d08(f: Facts) -> DataFrame:
    return f.task_f.groupBy("git_url", "tag_old", "tag_new").agg((F.count("*") > 1).alias("repeated"))


@query("P06_change_list", f"SELECT method_id, kind FROM ({CHANGED}) c UNION SELECT method_id, 'DELETED' FROM ({GONE}) g")
def p06(f: Facts) -> DataFrame:
    found = changes.method_changes(f.diff_f, f.method_f, f.method_v.filter("project_id = 1"))
    return found.union(changes.removed_methods(f.diff_f, f.method_f).withColumn("kind", F.lit("DELETED"))).distinct()


VERSION_FILES = f"SELECT m.method_id, m.method_name, m.parameters, {ENDINGS} AS path FROM {{method_v}} m JOIN {{class_f}} c ON c.class_id = m.class_id WHERE m.project_id = 1".replace("class_id %", "c.class_id %")


@query("J07_by_file_suffix", f"""SELECT v.method_id, CASE WHEN EXISTS (SELECT 1 FROM {{method_f}} m JOIN {{class_f}} c ON c.class_id = m.class_id WHERE (c.filepath = v.path OR ends_with(c.filepath, '/' || v.path)) AND m.method_name = v.method_name AND m.parameters = v.parameters) THEN 'MODIFIED' ELSE 'ADDED' END AS kind FROM ({VERSION_FILES}) v""")
def j07_suffix(f: Facts) -> DataFrame:
    """Methods of the increment, whose files are known by the ends of their paths: modified if the baseline's file has the method."""
    version = f.spark.sql(VERSION_FILES, method_v=f.method_v, class_f=f.class_f)
    base_files = lookup.suffix_join(version.select("path").distinct(), f.class_f.select("class_id", "filepath"), "path", "filepath").select("path", "class_id")
    keys = ["path", "method_name", "parameters"]
    known = base_files.join(f.method_f, "class_id").select(*keys).distinct().withColumn("known", F.lit(True))
    return version.join(known, keys, "left").select("method_id", F.when(F.col("known"), "MODIFIED").otherwise("ADDED").alias("kind"))
