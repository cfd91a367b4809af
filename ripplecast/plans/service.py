"""Queries of the service surface that are not registered with their operators (V*, K08, K10, S11, S15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..registry import query
from ..session import new_folder
from ..sources import documents


@query("V01_submit", """SELECT t.task_id, CASE WHEN a.git_url IS NOT NULL THEN 'ACTIVE_DUPLICATE' WHEN c.git_url IS NOT NULL THEN 'COMPLETED_DUPLICATE' ELSE 'INSERT' END AS answer FROM {task_f} t
  LEFT JOIN (SELECT git_url, tag_old, tag_new, min(task_id) AS id FROM {task_f} WHERE status IN ('pending', 'running') GROUP BY git_url, tag_old, tag_new) a ON t.git_url = a.git_url AND t.tag_old = a.tag_old AND t.tag_new = a.tag_new AND a.id < t.task_id
  LEFT JOIN (SELECT git_url, tag_old, tag_new, min(task_id) AS id FROM {task_f} WHERE status = 'completed' GROUP BY git_url, tag_old, tag_new) c ON t.git_url = c.git_url AND t.tag_old = c.tag_old AND t.tag_new = c.tag_new AND c.id < t.task_id""")
def v01(f: Facts) -> DataFrame:
    """The answer to each task, had it been submitted after those with lower ids."""
    keys = ["git_url", "tag_old", "tag_new"]
    first = f.task_f.groupBy(*keys).agg(F.min(F.when(F.col("status").isin("pending", "running"), F.col("task_id"))).alias("active"), F.min(F.when(F.col("status") == "completed", F.col("task_id"))).alias("completed"))
    answer = F.when(F.col("active") < F.col("task_id"), "ACTIVE_DUPLICATE").when(F.col("completed") < F.col("task_id"), "COMPLETED_DUPLICATE").otherwise("INSERT")
    return f.task_f.join(first, keys).select("task_id", answer.alias("answer"))


@query("V04_cancel", "SELECT task_id, status = 'pending' AS cancelled FROM {task_f}")
def v04(f: Facts) -> DataFrame:
    return f.task_f.select("task_id", (F.col("status") == "pending").alias("cancelled"))


@query("V07_baselines", "SELECT tag_old AS baseline, string_agg(DISTINCT tag_new, ',' ORDER BY tag_new) AS versions FROM {task_f} WHERE status = 'completed' GROUP BY tag_old")
def v07(f: Facts) -> DataFrame:
    return f.task_f.filter("status = 'completed'").groupBy(F.col("tag_old").alias("baseline")).agg(F.array_join(F.array_sort(F.collect_set("tag_new")), ",").alias("versions"))


@query("V08_version_info", "SELECT tag_old, tag_new, bool_or(status = 'completed') AS has_result, bool_or(status = 'running') AS is_running FROM {task_f} GROUP BY tag_old, tag_new")
def v08(f: Facts) -> DataFrame:
    return f.task_f.groupBy("tag_old", "tag_new").agg(F.bool_or(F.col("status") == "completed").alias("has_result"), F.bool_or(F.col("status") == "running").alias("is_running"))


@query("V12_sql_summary", "SELECT class_id, sql_type, count(*) AS n FROM {stmt_f} GROUP BY class_id, sql_type")
def v12(f: Facts) -> DataFrame:
    return f.stmt_f.groupBy("class_id", "sql_type").agg(F.count("*").alias("n"))


@query("S15_sql_summary_file", "SELECT class_id, sql_type, count(*) AS n FROM {stmt_f} WHERE sql_type = 'UPDATE' GROUP BY class_id, sql_type")
def s15(f: Facts) -> DataFrame:
    """The summary written as a table by kind of statement, and one kind's folder read."""
    path = new_folder(f.spark, "summary")
    v12(f).write.partitionBy("sql_type").parquet(path)
    return f.spark.read.parquet(path).filter("sql_type = 'UPDATE'").select("class_id", "sql_type", "n")


@query("V02_task_page", "SELECT task_id, status, (SELECT count(*) FROM {task_f}) AS total FROM {task_f} ORDER BY created_at DESC, task_id LIMIT 100")
def v02(f: Facts) -> DataFrame:
    """The first page, and the number of tasks: paging is the feature."""
    total = f.task_f.agg(F.count("*").alias("total"))
    return f.task_f.select("task_id", "status", "created_at").orderBy(F.desc("created_at"), "task_id").limit(100).join(F.broadcast(total)).select("task_id", "status", "total")


@query("V11_method_code", """SELECT coalesce(b.class_id, v.class_id) AS class_id, coalesce(b.method_name, v.method_name) AS method_name, coalesce(b.parameters, v.parameters) AS parameters,
  b.name || '(' || coalesce(b.parameters, '') || ') {{ // ' || CAST(b.start_line AS STRING) AS old_code, v.name || '(' || coalesce(v.parameters, '') || ') {{ // ' || CAST(v.start_line AS STRING) AS new_code
  FROM (SELECT DISTINCT ON (class_id, method_name, parameters) *, method_name AS name FROM {method_v} WHERE project_id = 0 ORDER BY class_id, method_name, parameters, method_id) b
  FULL JOIN (SELECT DISTINCT ON (class_id, method_name, parameters) *, method_name AS name FROM {method_v} WHERE project_id = 1 ORDER BY class_id, method_name, parameters, method_id) v ON b.class_id = v.class_id AND b.method_name = v.method_name AND b.parameters = v.parameters""")
def v11(f: Facts) -> DataFrame:
    """Baseline and current source of each method, by class and signature."""
    keys = ["class_id", "method_name", "parameters"]
    code = F.concat("method_name", F.lit("("), "parameters", F.lit(") { // "), F.col("start_line").cast("string"))
    side = lambda p: F.min_by(F.when(F.col("project_id") == p, code), F.when(F.col("project_id") == p, F.col("method_id")))
    return f.method_v.groupBy(*keys).agg(side(0).alias("old_code"), side(1).alias("new_code"))


@query("V13_conflicting_task", """SELECT t.task_id, count(r.task_id) AS running, min(r.task_id) FILTER (r.git_url = t.git_url AND r.tag_new = t.tag_new) AS conflict, count(r.task_id) >= 3 AS must_wait
  FROM {task_f} t LEFT JOIN (SELECT * FROM {task_f} WHERE status = 'running') r ON r.user_name = t.user_name AND r.git_url = t.git_url WHERE t.status = 'pending' GROUP BY t.task_id""")
def v13(f: Facts) -> DataFrame:
    """For each pending task: running ones of its user and repository, one with the same version, and the cap of 3."""
    running = f.task_f.filter("status = 'running'")
    n = running.groupBy("user_name", "git_url").agg(F.count("*").alias("n"))
    same = running.groupBy("user_name", "git_url", "tag_new").agg(F.min("task_id").alias("conflict"))
    rows = f.task_f.filter("status = 'pending'").join(n, ["user_name", "git_url"], "left").join(same, ["user_name", "git_url", "tag_new"], "left")
    return rows.select("task_id", F.coalesce("n", F.lit(0)).alias("running"), "conflict", (F.coalesce("n", F.lit(0)) >= 3).alias("must_wait"))


@query("V14_result_siblings", "SELECT r.task_id, r.result_id, t.status, CASE WHEN t.max_depth > 5 THEN 0 ELSE s.siblings END AS siblings FROM {llm_f} r JOIN {task_f} t ON r.task_id = t.task_id JOIN (SELECT task_id, count(*) - 1 AS siblings FROM {llm_f} GROUP BY task_id) s ON r.task_id = s.task_id")
def v14(f: Facts) -> DataFrame:
    """A result with its task, and the number of the task's other results unless it was a batch."""
    n = f.llm_f.groupBy("task_id").agg((F.count("*") - 1).alias("n"))
    rows = f.llm_f.join(f.task_f.select("task_id", "status", "max_depth"), "task_id").join(n, "task_id")
    return rows.select("task_id", "result_id", "status", F.when(F.col("max_depth") > 5, 0).otherwise(F.col("n")).alias("siblings"))


KINDS = ["user", "assistant", "system"]
LATEST = ", ".join(f"arg_max(task_id, CAST(created_at AS BIGINT) * 1000000000 + task_id) FILTER (kind = '{k}') AS {k}_task" for k in KINDS)


@query("V15_nodes_status", f"SELECT m.method_id, {', '.join(f'{k}_task' for k in KINDS)}, any_task FROM {{method_f}} m LEFT JOIN (SELECT method_name, {LATEST}, arg_max(task_id, CAST(created_at AS BIGINT) * 1000000000 + task_id) AS any_task FROM {{llm_f}} GROUP BY method_name) l ON l.method_name = 'm' || CAST(m.method_id % 7 AS STRING)")
def v15(f: Facts) -> DataFrame:
    """Four latest-row lookups per node in one aggregate: by kind, and over all kinds."""
    latest = lambda when: F.max_by(F.when(when, F.col("task_id")), F.when(when, F.struct("created_at", "task_id")))
    by_name = f.llm_f.groupBy("method_name").agg(*[latest(F.col("kind") == k).alias(f"{k}_task") for k in KINDS], latest(F.lit(True)).alias("any_task"))
    nodes = f.method_f.select("method_id", F.concat(F.lit("m"), (F.col("method_id") % 7).cast("string")).alias("method_name"))
    return nodes.join(by_name, "method_name", "left").drop("method_name")


KEYS = ["analysis_type", "direction", "baseline", "version", "class_name", "method_name", "change_type"]
FILLED = ["analysis_type", "direction", "coalesce(baseline, '') AS baseline", "coalesce(version, '') AS version", "class_name", "method_name", "change_type"]
FILLED_SQL = ", ".join(FILLED)


def filled(f: Facts) -> DataFrame:
    return f.cache_f.selectExpr(*FILLED, "id", "created_at")


@query("V19_cache_lookup", f"SELECT {', '.join(KEYS)}, max(created_at) AS created_at, arg_max(id, CAST(created_at AS BIGINT) * 1000000000 + id) AS id FROM (SELECT {FILLED_SQL}, id, created_at FROM {{cache_f}}) x GROUP BY ALL")
def v19(f: Facts) -> DataFrame:
    """The newest cached result of each of the seven-part keys; a null version or baseline is the empty one."""
    last = F.max(F.struct("created_at", "id")).alias("last")
    return filled(f).groupBy(*KEYS).agg(last).select(*KEYS, "last.created_at", "last.id")


@query("K08_cache_migration", f"SELECT max(id) AS id FROM (SELECT {FILLED_SQL}, id FROM {{cache_f}}) x GROUP BY {', '.join(KEYS)}")
def k08(f: Facts) -> DataFrame:
    """The row of the highest id of each seven-column group stays."""
    return filled(f).groupBy(*KEYS).agg(F.max("id").alias("id")).select("id")


@query("V18_cached_or_call", """SELECT m.method_id, c.id AS cached_id, CASE WHEN c.id IS NULL THEN 'call' ELSE 'cache' END AS answer FROM {method_f} m
  LEFT JOIN (SELECT class_name, method_name, change_type, max(id) AS id FROM {cache_f} WHERE analysis_result <> '' GROUP BY class_name, method_name, change_type) c
  ON c.class_name = 'C' || CAST(m.class_id % 6 AS STRING) AND c.method_name = 'm' || CAST(m.method_id % 4 AS STRING) AND c.change_type = m.change_type""")
def v18(f: Facts) -> DataFrame:
    """A cache lookup for each method; those without a hit go to the model."""
    keys = ["class_name", "method_name", "change_type"]
    cached = f.cache_f.filter("analysis_result <> ''").groupBy(*keys).agg(F.max("id").alias("cached_id"))
    asked = f.method_f.select("method_id", F.concat(F.lit("C"), (F.col("class_id") % 6).cast("string")).alias("class_name"), F.concat(F.lit("m"), (F.col("method_id") % 4).cast("string")).alias("method_name"), "change_type")
    return asked.join(cached, keys, "left").select("method_id", "cached_id", F.when(F.col("cached_id").isNull(), "call").otherwise("cache").alias("answer"))


@query("K10_save_result", "SELECT task_id, '{{\"task_id\":' || CAST(task_id AS STRING) || ',\"results\":[' || string_agg(CAST(result_id AS STRING), ',' ORDER BY result_id) || ']}}' AS doc FROM {llm_f} GROUP BY task_id")
def k10(f: Facts) -> DataFrame:
    """A JSON document a task, as it is saved."""
    return result_documents(f).select("task_id", F.to_json(F.struct("task_id", "results")).alias("doc"))


def result_documents(f: Facts) -> DataFrame:
    return f.llm_f.groupBy("task_id").agg(F.array_sort(F.collect_list("result_id")).alias("results"))


@query("S11_analysis_cache", "SELECT task_id, count(*) AS n, max(result_id) AS last_result FROM {llm_f} GROUP BY task_id")
def s11(f: Facts) -> DataFrame:
    """Saved as JSON files, and loaded again; a folder that is not there gives no rows."""
    path = new_folder(f.spark, "analysis")
    result_documents(f).write.json(path)
    read = documents.load_json(f.spark, path, "task_id long, results array<long>")
    return read.select("task_id", F.size("results").cast("long").alias("n"), F.array_max("results").alias("last_result"))
