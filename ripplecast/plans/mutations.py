"""Queries on sinks and mutations (K*), as the tables that they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import lookup
from ..registry import query
from ..sources import documents

OLD, NEW = "project_id = 0", "project_id = 1"


@query("K01_append", "SELECT method_id, project_id FROM {method_v} UNION ALL SELECT method_id, 2 FROM {method_f}")
def k01(f: Facts) -> DataFrame:
    return f.method_v.select("method_id", "project_id").union(f.method_f.select("method_id", F.lit(2)))


@query("K02_insert_absent", "SELECT class_id, method_name FROM {method_f} GROUP BY class_id, method_name UNION SELECT class_id + 1, method_name FROM {method_f} GROUP BY class_id, method_name")
def k02(f: Facts) -> DataFrame:
    have = f.method_f.select("class_id", "method_name").distinct()
    fresh = f.method_f.select((F.col("class_id") + 1).alias("class_id"), "method_name")
    return have.unionByName(lookup.insert_absent(have, fresh, ["class_id", "method_name"]))


@query("K03_project_insert", "SELECT git_url, tag_old, tag_new, min(task_id) AS project_id FROM {task_f} GROUP BY git_url, tag_old, tag_new")
def k03(f: Facts) -> DataFrame:
    return f.task_f.groupBy("git_url", "tag_old", "tag_new").agg(F.min("task_id").alias("project_id"))


@query("K04_replace_by_class", "SELECT method_id, class_id FROM {method_v} WHERE project_id = 1 UNION ALL SELECT method_id, class_id FROM {method_v} WHERE project_id = 0 AND class_id NOT IN (SELECT class_id FROM {method_v} WHERE project_id = 1)")
def k04(f: Facts) -> DataFrame:
    v = f.method_v.select("method_id", "class_id", "project_id")
    return lookup.upsert(v.filter(OLD), v.filter(NEW), ["class_id"]).select("method_id", "class_id")


@query("K05_update_where", "SELECT method_id, CASE WHEN brand = 'Brand#11' OR price > 1200 THEN 'MODIFIED' ELSE change_type END AS change_type FROM {method_f}")
def k05(f: Facts) -> DataFrame:
    return f.method_f.select("method_id", F.when(F.expr("brand = 'Brand#11' OR price > 1200"), "MODIFIED").otherwise(F.col("change_type")).alias("change_type"))


@query("K06_statement_upsert", "SELECT class_id, method_id, max(stmt_id) AS stmt_id FROM {stmt_f} GROUP BY class_id, method_id")
def k06(f: Facts) -> DataFrame:
    """The last loaded statement of each full name."""
    return f.stmt_f.groupBy("class_id", "method_id").agg(F.max("stmt_id").alias("stmt_id"))


@query("K07_cache_upsert", "SELECT DISTINCT ON (method_name, kind) method_name, kind, task_id, result_id FROM {llm_f} ORDER BY method_name, kind, task_id DESC, result_id DESC")
def k07(f: Facts) -> DataFrame:
    last = F.max(F.struct("task_id", "result_id")).alias("last")
    return f.llm_f.groupBy("method_name", "kind").agg(last).select("method_name", "kind", "last.task_id", "last.result_id")


@query("K09_compact_nodes", "SELECT method_id, CASE WHEN change_type = 'UNCHANGED' THEN '{{\"m\":\"' || method_name || '\"}}' ELSE '{{\"m\":\"' || method_name || '\",\"c\":\"' || change_type || '\"}}' END AS doc FROM {method_f}")
def k09(f: Facts) -> DataFrame:
    return f.method_f.select("method_id", documents.compact({"m": F.col("method_name"), "c": F.nullif("change_type", F.lit("UNCHANGED"))}).alias("doc"))


@query("S10_expand_defaults", "SELECT method_id, method_name, change_type FROM {method_f}")
def s10(f: Facts) -> DataFrame:
    """Compact documents read again with their defaults."""
    doc = documents.compact({"m": F.col("method_name"), "c": F.nullif("change_type", F.lit("UNCHANGED"))})
    read = documents.expanded(doc, "m string, c string", {"c": "UNCHANGED"})
    return f.method_f.select("method_id", read.alias("d")).select("method_id", F.col("d.m").alias("method_name"), F.col("d.c").alias("change_type"))


@query("K11_report_lines", "SELECT method_id, row_number() OVER (PARTITION BY class_id ORDER BY method_id) AS line_no, repeat(chr(9), 1) || method_name || ' (' || change_type || ')' AS line FROM {method_f} WHERE change_type <> 'UNCHANGED'")
def k11(f: Facts) -> DataFrame:
    from pyspark.sql import Window

    rows = f.method_f.filter("change_type <> 'UNCHANGED'")
    line = documents.report_line(F.lit(1), F.col("method_name"), F.col("change_type"))
    return rows.select("method_id", F.row_number().over(Window.partitionBy("class_id").orderBy("method_id")).alias("line_no"), line.alias("line"))


@query("K12_sql_boxes", "SELECT stmt_id, '| ' || rpad(left(sql_content, 40), 40, ' ') || ' |' AS line FROM {stmt_f}")
def k12(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", documents.box(F.col("sql_content"), 40).alias("line"))


@query("K13_graph_document", "SELECT class_id, '{{\"links\":[' || string_agg(CAST(callee_id AS STRING), ',' ORDER BY callee_id) || ']}}' AS doc FROM (SELECT DISTINCT m.class_id, e.callee_id FROM {edge_f} e JOIN {method_f} m ON m.method_id = e.caller_id) x GROUP BY class_id")
def k13(f: Facts) -> DataFrame:
    links = f.edge_f.join(f.method_f.select(F.col("method_id").alias("caller_id"), "class_id"), "caller_id").select("class_id", "callee_id").distinct()
    return links.groupBy("class_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("callee_id")).alias("links"))).alias("doc"))


@query("K14_latest_status", "SELECT git_url, arg_max(status, CAST(epoch(created_at) AS BIGINT) * 100000 + task_id) AS status FROM {task_f} GROUP BY git_url")
@query("T05_task_state", "SELECT git_url, arg_max(status, CAST(epoch(created_at) AS BIGINT) * 100000 + task_id) AS status FROM {task_f} GROUP BY git_url")
def k14(f: Facts) -> DataFrame:
    """Append-only status log and a view of the latest row."""
    return f.task_f.groupBy("git_url").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("status"))


@query("K15_delete_task", "SELECT task_id FROM {task_f} WHERE NOT (status = 'completed' AND max_depth = 0)")
def k15(f: Facts) -> DataFrame:
    gone = f.task_f.filter("status = 'completed' AND max_depth = 0").select("task_id")
    return f.task_f.select("task_id").join(gone, "task_id", "left_anti")


@query("K16_result_log", "SELECT task_id, count(*) AS results, max(created_at) AS updated FROM {llm_f} GROUP BY task_id")
def k16(f: Facts) -> DataFrame:
    return f.llm_f.groupBy("task_id").agg(F.count("*").alias("results"), F.max("created_at").alias("updated"))
