"""Queries on joins, aggregates, windows, sorting and sets (J*, A*, W*, L*, X*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import hierarchy, lookup
from ..operators.ranks import id_block, ranked
from ..registry import query


@query("J01_methods_classes", "SELECT m.method_id, c.package_name, c.class_name FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id")
def j01(f: Facts) -> DataFrame:
    return f.method_f.join(f.class_f, "class_id").select("method_id", "package_name", "class_name")


@query("J02_outer_to_inner", "SELECT m.method_id, c.class_name FROM {method_f} m LEFT JOIN {class_f} c ON m.class_id = c.class_id WHERE c.class_type = 'Interface'")
def j02(f: Facts) -> DataFrame:
    return f.method_f.join(f.class_f, "class_id", "left").filter("class_type = 'Interface'").select("method_id", "class_name")


@query("J03_results_with_tasks", "SELECT r.task_id, r.result_id, t.status, t.git_url FROM {llm_f} r JOIN {task_f} t ON r.task_id = t.task_id")
def j03(f: Facts) -> DataFrame:
    return f.llm_f.join(f.task_f.select("task_id", "status", "git_url"), "task_id").select("task_id", "result_id", "status", "git_url")


LINES = "SELECT DISTINCT class_id, line_no FROM {diff_f} WHERE op = '+'"


@query("J04_lines_in_methods", f"SELECT l.class_id, l.line_no, m.method_id FROM ({LINES}) l JOIN {{method_f}} m ON l.class_id = m.class_id AND l.line_no BETWEEN m.start_line AND m.end_line")
def j04(f: Facts) -> DataFrame:
    lines = f.diff_f.filter("op = '+'").select("class_id", "line_no").distinct()
    return lookup.lines_in_ranges(lines, f.method_f.select("class_id", "method_id", "start_line", "end_line")).select("class_id", "line_no", "method_id")


@query("J05_methods_hit", f"SELECT DISTINCT m.method_id FROM ({LINES}) l JOIN {{method_f}} m ON l.class_id = m.class_id AND l.line_no BETWEEN m.start_line AND m.end_line")
def j05(f: Facts) -> DataFrame:
    lines = f.diff_f.filter("op = '+'").select("class_id", "line_no").distinct()
    return lookup.lines_in_ranges(lines, f.method_f.select("class_id", "method_id", "start_line", "end_line")).select("method_id").distinct()


DIVISION = """SELECT m.method_id FROM {method_f} m JOIN (SELECT DISTINCT class_id, line_no FROM {diff_f} WHERE op = '-') l ON l.class_id = m.class_id AND l.line_no BETWEEN m.start_line AND m.end_line
  GROUP BY m.method_id, m.start_line, m.end_line HAVING count(*) = m.end_line - m.start_line + 1"""


@query("J06_all_lines_removed", DIVISION)
def j06(f: Facts) -> DataFrame:
    """Relational division by counting: all lines of a method are removed if as many are as it has."""
    lines = f.diff_f.filter("op = '-'").select("class_id", "line_no").distinct()
    hits = lookup.lines_in_ranges(lines, f.method_f.select("class_id", "method_id", "start_line", "end_line"))
    return hits.groupBy("method_id", "start_line", "end_line").agg(F.count("*").alias("n")).filter("n = end_line - start_line + 1").select("method_id")


@query("J07_added_or_modified", """SELECT v.method_id, CASE WHEN b.class_id IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS kind FROM {method_v} v
  LEFT JOIN (SELECT DISTINCT class_id, method_name, parameters FROM {method_f}) b ON v.class_id = b.class_id AND v.method_name = b.method_name AND v.parameters = b.parameters WHERE v.project_id = 1""")
def j07(f: Facts) -> DataFrame:
    keys = ["class_id", "method_name", "parameters"]
    base = f.method_f.select(*keys).distinct().withColumn("known", F.lit(True))
    return f.method_v.filter("project_id = 1").join(base, keys, "left").select("method_id", F.when(F.col("known"), "MODIFIED").otherwise("ADDED").alias("kind"))


@query("J08_reverse_index", "SELECT callee_id, count(DISTINCT caller_id) AS callers FROM {call_f} GROUP BY callee_id")
def j08(f: Facts) -> DataFrame:
    return f.edge_f.groupBy("callee_id").agg(F.count("*").alias("callers"))


@query("J09_callers_of_changed", "SELECT m.method_id, e.caller_id FROM {method_f} m JOIN {edge_f} e ON e.callee_id = m.method_id WHERE m.change_type <> 'UNCHANGED'")
def j09(f: Facts) -> DataFrame:
    changed = f.method_f.filter("change_type <> 'UNCHANGED'").select("method_id")
    return changed.join(f.edge_f, F.col("method_id") == F.col("callee_id")).select("method_id", "caller_id")


CALLS = "SELECT method_id AS call_id, class_id, method_name, CASE WHEN method_id % 2 = 0 THEN parameters ELSE 'Unknown' END AS parameters FROM {method_f}"


@query("J10_overload", f"""SELECT c.call_id, coalesce(e.id, a.id) AS method_id, e.id IS NOT NULL AS is_exact FROM ({CALLS}) c
  LEFT JOIN (SELECT class_id, method_name, parameters, min(method_id) AS id FROM {{method_f}} GROUP BY class_id, method_name, parameters) e ON c.class_id = e.class_id AND c.method_name = e.method_name AND c.parameters = e.parameters
  LEFT JOIN (SELECT class_id, method_name, min(method_id) AS id FROM {{method_f}} GROUP BY class_id, method_name) a ON c.class_id = a.class_id AND c.method_name = a.method_name""")
def j10(f: Facts) -> DataFrame:
    return lookup.resolve_overload(f.spark.sql(CALLS, method_f=f.method_f), f.method_f)


@query("J11_implementations", "SELECT i.class_id AS interface_id, c.class_id AS implementation_id FROM {class_f} c JOIN {class_f} i ON c.implements_id = i.class_id WHERE c.class_type = 'Class'")
def j11(f: Facts) -> DataFrame:
    own = f.class_f.filter("class_type = 'Class'").select(F.col("class_id").alias("implementation_id"), F.col("implements_id").alias("interface_id"))
    return own.join(f.class_f.select(F.col("class_id").alias("interface_id")), "interface_id").select("interface_id", "implementation_id")


BELOW = "SELECT implements_id AS src, class_id AS dst FROM {class_f} WHERE implements_id IS NOT NULL UNION SELECT b.src, k.class_id FROM b JOIN {class_f} k ON k.implements_id = b.dst"
OVERRIDES = """SELECT i.method_id AS interface_method, m.method_id AS implementing_method FROM {method_f} i JOIN {class_f} t ON i.class_id = t.class_id AND t.class_type = 'Interface' JOIN b ON b.src = t.class_id AND b.dst <> b.src
  JOIN {class_f} c ON c.class_id = b.dst AND c.class_type = 'Class' JOIN {method_f} m ON m.class_id = c.class_id AND m.method_name = i.method_name AND m.parameters = i.parameters"""


@query("J12_interface_methods", f"WITH RECURSIVE b AS ({BELOW}) {OVERRIDES}")
def j12(f: Facts) -> DataFrame:
    return hierarchy.implementing_methods(f.method_f, f.class_f)


@query("P11_concrete_methods", f"WITH RECURSIVE b AS ({BELOW}) SELECT m.method_id AS called, m.method_id AS concrete FROM {{method_f}} m JOIN {{class_f}} c ON c.class_id = m.class_id AND c.class_type = 'Class' UNION ALL SELECT interface_method, implementing_method FROM ({OVERRIDES}) o")
def p11(f: Facts) -> DataFrame:
    return hierarchy.concrete_methods(f.method_f, f.class_f)


@query("J13_link_statements", "SELECT s.stmt_id, m.method_id AS linked FROM {stmt_f} s LEFT JOIN {method_f} m ON m.class_id = s.class_id AND m.method_id = s.linked_method_id")
def j13(f: Facts) -> DataFrame:
    m = f.method_f.select("class_id", F.col("method_id").alias("linked_method_id"), F.col("method_id").alias("linked"))
    return f.stmt_f.join(m, ["class_id", "linked_method_id"], "left").select("stmt_id", "linked")


@query("J14_method_sql", "SELECT m.method_id, s.sql_type FROM {method_f} m LEFT JOIN {stmt_f} s ON s.linked_method_id = m.method_id")
def j14(f: Facts) -> DataFrame:
    return f.method_f.select("method_id").join(f.stmt_f.select(F.col("linked_method_id").alias("method_id"), "sql_type"), "method_id", "left")


@query("J15_changed_references", "SELECT stmt_id FROM {stmt_f} s WHERE EXISTS (SELECT 1 FROM {class_f} c WHERE c.change_type = 'MODIFIED' AND c.class_id = s.class_id) OR EXISTS (SELECT 1 FROM {method_f} m WHERE m.change_type = 'MODIFIED' AND m.method_id = s.linked_method_id)")
def j15(f: Facts) -> DataFrame:
    """Two equi semi-joins in place of one with OR."""
    by_class = f.stmt_f.join(f.class_f.filter("change_type = 'MODIFIED'").select("class_id"), "class_id", "left_semi").select("stmt_id")
    by_method = f.stmt_f.join(f.method_f.filter("change_type = 'MODIFIED'").select(F.col("method_id").alias("linked_method_id")), "linked_method_id", "left_semi").select("stmt_id")
    return by_class.union(by_method).distinct()


@query("J16_preferred_version", "SELECT DISTINCT ON (class_id, method_name) class_id, method_name, method_id, project_id FROM {method_v} ORDER BY class_id, method_name, project_id DESC, method_id")
@query("J17_increment_first", "SELECT DISTINCT ON (class_id, method_name) class_id, method_name, method_id, project_id FROM {method_v} ORDER BY class_id, method_name, project_id DESC, method_id")
def j16(f: Facts) -> DataFrame:
    return lookup.first_per_key(f.method_v, ["class_id", "method_name"], [F.desc("project_id"), F.asc("method_id")]).select("class_id", "method_name", "method_id", "project_id")


@query("J18_type_in_imports", "SELECT DISTINCT i.class_id, t.class_id AS type_id FROM {import_f} i JOIN {class_f} t ON CASE WHEN i.is_wildcard THEN t.package_name = i.import_path ELSE t.package_name || '.' || t.class_name = i.import_path END JOIN {class_f} c ON c.class_id = i.class_id AND c.project_id = t.project_id")
def j18(f: Facts) -> DataFrame:
    """Types of the same project that an import names, or whose package one takes in whole: two equi joins.

    Imports and types are made distinct before they meet, and a named type is left out where its package is imported too,
    so the pairs need no distinct of their own."""
    types = f.class_f.select(F.col("class_id").alias("type_id"), "project_id", "package_name", F.concat_ws(".", "package_name", "class_name").alias("full_name")).distinct()
    imports = f.import_f.join(f.class_f.select("class_id", "project_id"), "class_id")
    whole = imports.filter("is_wildcard").select("class_id", "project_id", F.col("import_path").alias("package_name")).distinct()
    named = imports.filter("NOT is_wildcard").join(types.withColumnRenamed("full_name", "import_path"), ["project_id", "import_path"])
    named = named.join(whole, ["class_id", "project_id", "package_name"], "left_anti").select("class_id", "type_id").distinct()
    members = types.select("project_id", "package_name", "type_id").distinct()
    return named.union(lookup.split_join(whole, members, ["project_id", "package_name"], "type_id").select("class_id", "type_id"))


@query("J19_field_type", "SELECT x.field_id, c.class_id FROM {field_f} x JOIN {class_f} c ON c.class_name = x.field_type")
def j19(f: Facts) -> DataFrame:
    """Fields by the class that is their type."""
    return f.field_f.select("field_id", "field_type").join(f.class_f.select("class_id", F.col("class_name").alias("field_type")), "field_type").select("field_id", "class_id")


@query("J21_tag_fallback", "SELECT t.task_id, coalesce(n.n_name, t.tag_new) AS full_tag FROM {task_f} t LEFT JOIN {nation} n ON 'v' || CAST(n.n_nationkey AS STRING) = t.tag_new")
def j21(f: Facts) -> DataFrame:
    names = f.nation.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("tag_new"), "n_name")
    return f.task_f.join(names, "tag_new", "left").select("task_id", F.coalesce("n_name", "tag_new").alias("full_tag"))


@query("J22_duplicate_task", """SELECT DISTINCT ON (git_url, tag_old, tag_new, max_depth) git_url, tag_old, tag_new, max_depth, task_id FROM {task_f} WHERE status IN ('pending', 'running') ORDER BY git_url, tag_old, tag_new, max_depth, created_at DESC, task_id""")
def j22(f: Facts) -> DataFrame:
    keys = ["git_url", "tag_old", "tag_new", "max_depth"]
    return lookup.first_per_key(f.task_f.filter(F.col("status").isin("pending", "running")), keys, [F.desc("created_at"), F.asc("task_id")]).select(*keys, "task_id")


@query("J23_free_pending", "SELECT task_id FROM {task_f} WHERE status = 'pending' AND git_url NOT IN (SELECT git_url FROM {task_f} WHERE status = 'running' AND max_depth = 0)")
def j23(f: Facts) -> DataFrame:
    busy = f.task_f.filter("status = 'running' AND max_depth = 0").select("git_url").distinct()
    return f.task_f.filter("status = 'pending'").join(busy, "git_url", "left_anti").select("task_id")


SIDES = "SELECT class_id, method_name, parameters, min(method_id) AS id FROM {method_v} WHERE project_id = %d GROUP BY class_id, method_name, parameters"


@query("J24_both_versions", f"SELECT coalesce(b.class_id, v.class_id) AS class_id, coalesce(b.method_name, v.method_name) AS method_name, coalesce(b.parameters, v.parameters) AS parameters, b.id AS old_id, v.id AS new_id FROM ({SIDES % 0}) b FULL JOIN ({SIDES % 1}) v ON b.class_id = v.class_id AND b.method_name = v.method_name AND b.parameters = v.parameters")
def j24(f: Facts) -> DataFrame:
    """One grouping in place of a full join: each version's id per key."""
    side = lambda p: F.min(F.when(F.col("project_id") == p, F.col("method_id")))
    return f.method_v.groupBy("class_id", "method_name", "parameters").agg(side(0).alias("old_id"), side(1).alias("new_id"))


@query("J25_best_constructor", "SELECT class_id, method_name, max(len) AS arity, arg_max(method_id, len * 1000000 - method_id) AS method_id FROM (SELECT *, CASE parameters WHEN '' THEN 0 WHEN 'Long' THEN 1 WHEN 'java.lang.Long' THEN 1 ELSE 2 END AS len FROM {method_f}) x GROUP BY class_id, method_name")
def j25(f: Facts) -> DataFrame:
    from ..functions.names import split_types

    x = f.method_f.withColumn("len", F.size(split_types(F.col("parameters"))))
    return x.groupBy("class_id", "method_name").agg(F.max("len").alias("arity"), F.max_by("method_id", F.struct("len", -F.col("method_id"))).alias("method_id"))


@query("A01_class_changes", "SELECT change_type, count(*) AS n FROM {class_f} GROUP BY change_type")
def a01(f: Facts) -> DataFrame:
    return f.class_f.groupBy("change_type").agg(F.count("*").alias("n"))


@query("A02_method_changes", "SELECT change_type, count(*) AS n FROM {method_f} GROUP BY change_type")
def a02(f: Facts) -> DataFrame:
    return f.method_f.groupBy("change_type").agg(F.count("*").alias("n")).orderBy("change_type")


@query("A04_task_count", "SELECT count(*) AS total FROM {task_f}")
def a04(f: Facts) -> DataFrame:
    return f.task_f.agg(F.count("*").alias("total"))


@query("A05_status_counts", "SELECT s AS status, count(task_id) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed')) v(s) LEFT JOIN {task_f} ON status = s GROUP BY s")
@query("V03_task_stats", "SELECT s AS status, count(task_id) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed')) v(s) LEFT JOIN {task_f} ON status = s GROUP BY s")
def a05(f: Facts) -> DataFrame:
    """Zero-filled: counted first, then joined to the four statuses."""
    statuses = f.spark.createDataFrame([(s,) for s in ("pending", "running", "completed", "failed")], "status string")
    return statuses.join(f.task_f.groupBy("status").agg(F.count("*").alias("c")), "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n"))


@query("A06_tracking", "SELECT 'project:' || project_code AS item, count(*) AS n FROM {task_f} WHERE project_code <> '' GROUP BY project_code UNION ALL SELECT 'user:' || user_name, count(*) FROM {task_f} GROUP BY user_name UNION ALL SELECT 'total', count(*) FROM {task_f}")
@query("V06_tracking", "SELECT 'project:' || project_code AS item, count(*) AS n FROM {task_f} WHERE project_code <> '' GROUP BY project_code UNION ALL SELECT 'user:' || user_name, count(*) FROM {task_f} GROUP BY user_name UNION ALL SELECT 'total', count(*) FROM {task_f}")
def a06(f: Facts) -> DataFrame:
    """One pass by grouping sets."""
    x = f.spark.sql("SELECT grouping_id(project_code, user_name) AS g, project_code, user_name, count(*) AS n FROM {task_f} GROUP BY GROUPING SETS ((project_code), (user_name), ())", task_f=f.task_f)
    item = F.when(F.col("g") == 1, F.concat(F.lit("project:"), "project_code")).when(F.col("g") == 2, F.concat(F.lit("user:"), "user_name")).otherwise("total")
    return x.filter("g <> 1 OR project_code <> ''").select(item.alias("item"), "n")


@query("A07_next_id", "SELECT coalesce(max(project_id) + 1, 1) AS next_id FROM {method_v}")
def a07(f: Facts) -> DataFrame:
    return f.method_v.agg(F.coalesce(F.max("project_id") + 1, F.lit(1)).alias("next_id"))


@query("A12_call_sites", "SELECT callee_id, caller_id, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, count(DISTINCT line) > 1 AS several FROM {call_f} GROUP BY callee_id, caller_id")
def a12(f: Facts) -> DataFrame:
    lines = F.array_sort(F.collect_set("line"))
    return f.call_f.groupBy("callee_id", "caller_id").agg(F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("lines"), (F.size(F.collect_set("line")) > 1).alias("several"))


@query("A17_timing_summary", "SELECT count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(avg(response_time), 4) AS mean, arg_max(event_id, response_time * 1e6 - event_id * 1e-6) AS slowest FROM {log_f}")
def a17(f: Facts) -> DataFrame:
    return f.log_f.agg(
        F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg("response_time"), 4).alias("mean"),
        F.max_by("event_id", F.struct("response_time", -F.col("event_id"))).alias("slowest"),
    )


@query("A18_line_counts", "SELECT class_id, count(*) FILTER (op = '+') AS added, count(*) FILTER (op = '-') AS removed FROM {diff_f} GROUP BY class_id")
def a18(f: Facts) -> DataFrame:
    return f.diff_f.groupBy("class_id").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))


@query("A20_key_status", "SELECT api_key, count(*) AS calls, count(*) FILTER (success) AS ok, round(100.0 * count(*) FILTER (success) / count(*), 2) AS rate FROM {log_f} GROUP BY api_key")
def a20(f: Facts) -> DataFrame:
    ok = F.count_if("success")
    return f.log_f.groupBy("api_key").agg(F.count("*").alias("calls"), ok.alias("ok"), F.round(100.0 * ok / F.count("*"), 2).alias("rate"))


@query("A21_impacted_apis", "SELECT m.method_id, c.controller_base_url AS path FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id WHERE m.is_api AND m.change_type <> 'UNCHANGED'")
def a21(f: Facts) -> DataFrame:
    return f.method_f.filter("is_api AND change_type <> 'UNCHANGED'").join(f.class_f, "class_id").select("method_id", F.col("controller_base_url").alias("path"))


@query("A22_distinct_tags", "SELECT DISTINCT tag_old, tag_new FROM {task_f}")
def a22(f: Facts) -> DataFrame:
    return f.task_f.select("tag_old", "tag_new").distinct()


@query("A23_first_of_key", "SELECT class_id, method_name, min(method_id) AS method_id FROM {method_f} GROUP BY class_id, method_name")
def a23(f: Facts) -> DataFrame:
    return lookup.first_per_key(f.method_f, ["class_id", "method_name"], [F.asc("method_id")]).select("class_id", "method_name", "method_id")


@query("A24_percent_of_total", "SELECT status, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM {task_f} GROUP BY status")
def a24(f: Facts) -> DataFrame:
    counts = f.task_f.groupBy("status").agg(F.count("*").alias("n"))
    return counts.select("status", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))


@query("W01_first_by_line", "SELECT DISTINCT ON (class_id, line_no) class_id, line_no, method_id FROM (SELECT l.class_id, l.line_no, m.method_id, m.start_line FROM (SELECT DISTINCT class_id, line_no FROM {diff_f}) l JOIN {method_f} m ON l.class_id = m.class_id AND l.line_no BETWEEN m.start_line AND m.end_line) x ORDER BY class_id, line_no, start_line, method_id")
def w01(f: Facts) -> DataFrame:
    hits = lookup.lines_in_ranges(f.diff_f.select("class_id", "line_no").distinct(), f.method_f.select("class_id", "method_id", "start_line", "end_line"))
    return lookup.first_per_key(hits, ["class_id", "line_no"], [F.asc("start_line"), F.asc("method_id")]).select("class_id", "line_no", "method_id")


@query("W02_latest_result", "SELECT method_name, kind, max(created_at) AS latest_at, arg_max(task_id, CAST(created_at AS BIGINT) * 1000000000 + task_id) AS latest_task FROM {llm_f} GROUP BY method_name, kind")
def w02(f: Facts) -> DataFrame:
    """Latest by time, then by task: an aggregate with map-side combine in place of a window."""
    last = F.max(F.struct("created_at", "task_id")).alias("last")
    return f.llm_f.groupBy("method_name", "kind").agg(last).select("method_name", "kind", F.col("last.created_at").alias("latest_at"), F.col("last.task_id").alias("latest_task"))


@query("W03_latest_project", "SELECT class_id, max(project_id) AS project_id FROM {method_v} GROUP BY class_id")
def w03(f: Facts) -> DataFrame:
    return f.method_v.groupBy("class_id").agg(F.max("project_id").alias("project_id"))


@query("W04_latest_completed", "SELECT DISTINCT ON (git_url, tag_new) git_url, tag_new, task_id FROM {task_f} WHERE status = 'completed' ORDER BY git_url, tag_new, created_at DESC, task_id DESC")
def w04(f: Facts) -> DataFrame:
    return f.task_f.filter("status = 'completed'").groupBy("git_url", "tag_new").agg(F.max_by("task_id", F.struct("created_at", "task_id")).alias("task_id"))


@query("W05_last_cache_row", "SELECT method_name, kind, max(task_id * 1000 + result_id) AS last_id FROM {llm_f} GROUP BY method_name, kind")
def w05(f: Facts) -> DataFrame:
    return f.llm_f.groupBy("method_name", "kind").agg(F.max(F.col("task_id") * 1000 + F.col("result_id")).alias("last_id"))


@query("W06_rank_in_level", "SELECT class_id, class_id % 10 AS level, row_number() OVER (PARTITION BY class_id % 10 ORDER BY class_id) AS place FROM {class_f}")
def w06(f: Facts) -> DataFrame:
    return ranked(f.class_f.select("class_id", (F.col("class_id") % 10).alias("level")), ["level"], ["class_id"], id_block("class_id"))


@query("W07_chain_ordinal", "SELECT method_id, row_number() OVER (PARTITION BY class_id ORDER BY start_line, method_id) AS ordinal FROM {method_f} WHERE change_type <> 'UNCHANGED'")
def w07(f: Facts) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy("start_line", "method_id"))
    return f.method_f.filter("change_type <> 'UNCHANGED'").select("method_id", nth.alias("ordinal"))


@query("W08_hunk_lines", "SELECT hunk, pos, CAST(sum(CASE WHEN op <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY hunk ORDER BY pos, line_no, op ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_line FROM {diff_f}")
def w08(f: Facts) -> DataFrame:
    w = Window.partitionBy("hunk").orderBy("pos", "line_no", "op").rowsBetween(Window.unboundedPreceding, 0)
    return f.diff_f.select("hunk", "pos", F.sum(F.when(F.col("op") != "-", 1).otherwise(0)).over(w).alias("new_line"))


PAGE = 100


@query("L01_task_page", "SELECT task_id FROM {task_f} ORDER BY created_at DESC, task_id LIMIT 100 OFFSET 200")
def l01(f: Facts) -> DataFrame:
    """The third page: paging is the feature."""
    return f.task_f.select("task_id", "created_at").orderBy(F.desc("created_at"), "task_id").offset(2 * PAGE).limit(PAGE).select("task_id")


@query("L02_page_info", "SELECT count(*) AS total, count(*) > 300 AS has_more FROM {task_f}")
def l02(f: Facts) -> DataFrame:
    return f.task_f.agg(F.count("*").alias("total"), (F.count("*") > 3 * PAGE).alias("has_more"))


@query("L03_callers_by_line", "SELECT callee_id, caller_id, row_number() OVER (PARTITION BY callee_id ORDER BY coalesce(first_line, 999999), caller_id) AS place FROM {edge_f}")
def l03(f: Facts) -> DataFrame:
    w = Window.partitionBy("callee_id").orderBy(F.coalesce("first_line", F.lit(999999)), "caller_id")
    return f.edge_f.select("callee_id", "caller_id", F.row_number().over(w).alias("place"))


@query("L04_slowest", "SELECT event_id, response_time FROM {log_f} WHERE success ORDER BY response_time DESC, event_id LIMIT 10")
def l04(f: Facts) -> DataFrame:
    """Top ten: the limit is the feature."""
    return f.log_f.filter("success").orderBy(F.desc("response_time"), "event_id").limit(10).select("event_id", "response_time")


@query("L05_changed_ordered", "SELECT change_type, method_name, method_id FROM {method_f} WHERE change_type <> 'UNCHANGED' ORDER BY change_type, method_name, method_id")
def l05(f: Facts) -> DataFrame:
    return f.method_f.filter("change_type <> 'UNCHANGED'").select("change_type", "method_name", "method_id").orderBy("change_type", "method_name", "method_id")


@query("L06_choose_key", "SELECT api_key FROM {log_f} GROUP BY api_key ORDER BY count(*), count(*) FILTER (success) DESC, api_key LIMIT 1")
def l06(f: Facts) -> DataFrame:
    return f.log_f.groupBy("api_key").agg(F.count("*").alias("calls"), F.count_if("success").alias("ok")).orderBy("calls", F.desc("ok"), "api_key").limit(1).select("api_key")


@query("L07_next_task", "SELECT task_id FROM {task_f} WHERE status = 'pending' AND git_url NOT IN (SELECT git_url FROM {task_f} WHERE status = 'running' AND max_depth = 0) ORDER BY created_at, task_id LIMIT 1")
def l07(f: Facts) -> DataFrame:
    busy = f.task_f.filter("status = 'running' AND max_depth = 0").select("git_url").distinct()
    return f.task_f.filter("status = 'pending'").join(busy, "git_url", "left_anti").orderBy("created_at", "task_id").limit(1).select("task_id")


@query("L08_changed_first", "SELECT class_id, method_id FROM (SELECT class_id, method_id, row_number() OVER (PARTITION BY class_id ORDER BY change_type = 'UNCHANGED', method_id) AS n FROM {method_f}) x WHERE n <= 8")
def l08(f: Facts) -> DataFrame:
    """Changed methods first, eight a class: the limit is the report's."""
    w = Window.partitionBy("class_id").orderBy(F.col("change_type") == "UNCHANGED", "method_id")
    return f.method_f.withColumn("n", F.row_number().over(w)).filter("n <= 8").select("class_id", "method_id")


@query("L09_methods_by_depth", "SELECT class_id, method_name, min(start_line) AS first_line FROM {method_f} GROUP BY class_id, method_name ORDER BY first_line, class_id, method_name")
def l09(f: Facts) -> DataFrame:
    return f.method_f.groupBy("class_id", "method_name").agg(F.min("start_line").alias("first_line")).orderBy("first_line", "class_id", "method_name")


KEYS = "class_id, method_name"
MERGED = f"SELECT method_id, project_id FROM {{method_v}} WHERE project_id = 1 UNION ALL SELECT method_id, project_id FROM {{method_v}} b WHERE project_id = 0 AND change_type <> 'DELETED' AND ({KEYS}) NOT IN (SELECT {KEYS} FROM {{method_v}} WHERE project_id = 1)"


@query("X01_merge_versions", MERGED)
def x01(f: Facts) -> DataFrame:
    v = f.method_v
    return lookup.merge_versions(v.filter("project_id = 0"), v.filter("project_id = 1"), ["class_id", "method_name"]).select("method_id", "project_id")


@query("X02_touched_lines", "SELECT class_id, line_no FROM {diff_f} WHERE op = '+' UNION SELECT class_id, line_no FROM {diff_f} WHERE op = '-'")
def x02(f: Facts) -> DataFrame:
    return f.diff_f.filter("op IN ('+', '-')").select("class_id", "line_no").distinct()


@query("X03_subset", "SELECT caller_id, bool_and(line <= 4) AS subset FROM {call_f} GROUP BY caller_id")
def x03(f: Facts) -> DataFrame:
    return f.call_f.groupBy("caller_id").agg(F.bool_and(F.col("line") <= 4).alias("subset"))


@query("X04_glob_union", "SELECT filepath FROM {class_f} WHERE class_name LIKE '%Mapper' UNION SELECT filepath FROM {class_f} WHERE class_type = 'Interface'")
def x04(f: Facts) -> DataFrame:
    return f.class_f.filter(F.col("class_name").endswith("Mapper")).select("filepath").union(f.class_f.filter("class_type = 'Interface'").select("filepath")).distinct()


@query("X06_unlisted_versions", "SELECT DISTINCT 'v' || CAST(n_nationkey AS STRING) AS version FROM {nation} WHERE 'v' || CAST(n_nationkey AS STRING) NOT IN (SELECT tag_new FROM {task_f})")
def x06(f: Facts) -> DataFrame:
    disk = f.nation.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("version")).distinct()
    return disk.join(f.task_f.select(F.col("tag_new").alias("version")).distinct(), "version", "left_anti")


@query("X07_undirected_links", "SELECT DISTINCT least(caller_id, callee_id) AS a, greatest(caller_id, callee_id) AS b FROM {edge_f} WHERE caller_id <> callee_id")
def x07(f: Facts) -> DataFrame:
    return f.edge_f.filter("caller_id <> callee_id").select(F.least("caller_id", "callee_id").alias("a"), F.greatest("caller_id", "callee_id").alias("b")).distinct()


@query("X08_node_upsert", "SELECT class_id, method_name, array_to_string(list_sort(list(DISTINCT change_type)), ',') AS diff_types FROM {method_f} GROUP BY class_id, method_name")
def x08(f: Facts) -> DataFrame:
    return f.method_f.groupBy("class_id", "method_name").agg(F.array_join(F.array_sort(F.collect_set("change_type")), ",").alias("diff_types"))
