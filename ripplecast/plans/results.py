"""Queries on result documents of chain runs: P03, P04, P05, V09, K10, K12 and K13 with nested trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import graph, results
from ..operators.hierarchy import implementing_methods
from ..registry import query
from ..session import new_folder, written
from ..sources import documents
from .chains import CHA_DOWN, DEPTH, ENTRY, UP, linked_statements, reverse

BOX = 60


def above(f: Facts, edges: DataFrame):
    return lambda roots: graph.chain_levels(roots, edges, DEPTH)


def steps_down(f: Facts) -> DataFrame:
    """Calls, and steps from an interface's method to those that implement it, as edges."""
    steps = implementing_methods(f.method_f, f.class_f).union(f.edge_f.select("caller_id", "callee_id")).distinct()
    return written(steps.toDF("src", "dst").withColumn("line", F.lit(None).cast("int")))


def run_up(f: Facts) -> DataFrame:
    edges = reverse(f)
    return results.upwards(f.method_f, f.class_f, edges, above(f, edges), DEPTH)


def run_down(f: Facts) -> DataFrame:
    edges = steps_down(f)
    return results.downwards(f.method_f, f.class_f, linked_statements(f), edges, above(f, edges), DEPTH)


# The same by string building: the nodes of a walk, then a tree a level, deepest first.
NAMES = f"""names AS (SELECT m.method_id, c.class_name || '.' || m.method_name AS name, nullif(m.change_type, 'UNCHANGED') AS change, c.class_name, m.method_name, m.parameters, m.change_type, c.change_type = 'DELETED' AS lost, e.entry_type
  FROM {{method_f}} m JOIN {{class_f}} c ON c.class_id = m.class_id LEFT JOIN ({ENTRY}) e ON e.method_id = m.method_id)"""
FIELD = "'{{\"node_id\":' || CAST(n.node_id AS STRING) || ',\"name\":\"' || name || '\"' || coalesce(',\"change\":\"' || change || '\"', '') || coalesce(',\"line\":' || CAST(n.line AS STRING), '') || coalesce(',\"entry\":\"' || entry_type || '\"', '') || CASE WHEN is_cyclic THEN ',\"cyclic\":true' ELSE '' END"
SQL_FIELD = " || coalesce(',\"sql\":' || sql, '')"
STATEMENTS = """stmts AS (SELECT linked_method_id AS method_id, '[' || string_agg('{{"stmt_id":' || CAST(stmt_id AS STRING) || ',"sql_type":"' || sql_type || '","sql_content":' || CAST(to_json(sql_content) AS STRING) || '}}', ',' ORDER BY stmt_id) || ']' AS sql FROM {stmt_f} WHERE linked_method_id IS NOT NULL GROUP BY linked_method_id)"""


def tree_sql(walk: str, mark: str, fields: str, joins: str) -> str:
    """Tables {mark}0 to {mark}5 with doc, the tree of each node at a depth, from walk (root_id, depth, node_id, line, seen, is_cyclic)."""
    nodes = f"(SELECT n.*, {fields} AS head FROM {walk} n JOIN names x ON x.method_id = n.node_id {joins})"
    out = [f"{mark}{DEPTH} AS (SELECT root_id, seen, line, node_id, head || '}}}}' AS doc FROM {nodes} q WHERE depth = {DEPTH})"]
    for d in range(DEPTH - 1, -1, -1):
        kids = f"(SELECT root_id, list_slice(seen, 1, {d + 1}) AS seen, string_agg(doc, ',' ORDER BY line NULLS LAST, node_id) AS kids FROM {mark}{d + 1} GROUP BY ALL)"
        out.append(f"{mark}{d} AS (SELECT q.root_id, q.seen, line, node_id, head || coalesce(',\"children\":[' || kids || ']', '') || '}}}}' AS doc FROM {nodes} q LEFT JOIN {kids} k ON k.root_id = q.root_id AND k.seen = q.seen WHERE depth = {d})")
    return ", ".join(out)


METHOD = "'{{\"id\":' || CAST(method_id AS STRING) || ',\"class_name\":\"' || class_name || '\",\"method_name\":\"' || method_name || '\",\"parameters\":\"' || parameters || '\",\"change\":\"' || change_type || '\"}}'"
FAILED = f"SELECT 'failed' AS kind, method_id AS root_id, '{{{{\"method\":' || {METHOD} || ',\"error\":\"CLASS_NOT_FOUND\"}}}}' AS doc FROM names WHERE lost AND change IS NOT NULL"
STATS = "'{{\"nodes\":' || CAST(nodes AS STRING) || ',\"depth\":' || CAST(depth AS STRING) || ',\"cyclic\":' || CAST(cyclic AS STRING) || ',\"cut\":' || CAST(cut AS STRING) || '}}'"
TOTAL = "'\",\"total_methods\":' || CAST(total + lost AS STRING) || ',\"successful_chains\":' || CAST(total AS STRING) || ',\"failed_chains\":' || CAST(lost AS STRING) || ',\"max_depth\":" + str(DEPTH) + ",\"stats\":{{'"

UP_LIMITS = "list_filter([CASE WHEN depth = 0 THEN 'NO_CALLER' END, CASE WHEN n_points = 0 THEN 'NO_ENTRY_POINT' END, CASE WHEN cyclic > 0 THEN 'CYCLE_DETECTED' END, CASE WHEN cut > 0 THEN 'DEPTH_LIMITED' END], lambda x: x IS NOT NULL)"
UP_RUN = (
    f"{UP}, {NAMES}, seeds AS (SELECT * FROM names WHERE NOT lost AND change IS NOT NULL), uw AS (SELECT up.* FROM up JOIN seeds s ON s.method_id = up.root_id), "
    + tree_sql("uw", "ut", FIELD, "")
    + f""", points AS (SELECT root_id, '[' || string_agg('{{{{"node_id":' || CAST(node_id AS STRING) || ',"entry":"' || entry_type || '","depth":' || CAST(depth AS STRING) || '}}}}', ',' ORDER BY node_id) || ']' AS points, count(*) AS n_points
    FROM (SELECT root_id, node_id, entry_type, min(depth) AS depth FROM uw JOIN names x ON x.method_id = node_id WHERE entry_type IS NOT NULL GROUP BY ALL) z GROUP BY root_id),
  measures AS (SELECT u.*, coalesce(n_points, 0) AS n_points, coalesce(points, '[]') AS points FROM (SELECT root_id, count(*) AS nodes, max(depth) AS depth, count(*) FILTER (is_cyclic) AS cyclic, count(*) FILTER (depth = {DEPTH} AND NOT is_cyclic AND node_id IN (SELECT callee_id FROM {{edge_f}})) AS cut FROM uw GROUP BY root_id) u LEFT JOIN points p ON p.root_id = u.root_id),
  noted AS (SELECT *, {UP_LIMITS} AS limits FROM measures),
  totals AS (SELECT count(*) AS total, count(*) FILTER (depth > 0) AS with_callers, coalesce(sum(cyclic), 0) AS cyclic, coalesce(sum(cut), 0) AS cut, coalesce(sum(n_points), 0) AS n, (SELECT count(*) FROM names WHERE lost AND change IS NOT NULL) AS lost FROM noted),
  rated AS (SELECT *, coalesce(round(100.0 * with_callers / total, 2), 0.0)::DOUBLE AS coverage FROM totals),
  advised AS (SELECT *, list_filter([CASE WHEN coverage < 30 THEN 'LOW_COVERAGE' END, CASE WHEN cut > 0 THEN 'RAISE_DEPTH' END, CASE WHEN n = 0 AND with_callers > 0 THEN 'NO_ENTRY_POINTS' END], lambda x: x IS NOT NULL) AS advice FROM rated),
  up_run AS (SELECT 'chain' AS kind, m.root_id, '{{{{"direction":"upwards","method":' || {METHOD} || ',"entry_points":' || points || ',"stats":' || {STATS} || ',"limitations":' || CAST(to_json(limits) AS STRING) || ',"has_incomplete_paths":' || CASE WHEN len(limits) > 0 THEN 'true' ELSE 'false' END || ',"chain":' || t.doc || '}}}}' AS doc
    FROM noted m JOIN ut0 t ON t.root_id = m.root_id JOIN names s ON s.method_id = m.root_id
    UNION ALL {FAILED}
    UNION ALL SELECT 'metadata', NULL, '{{{{"direction":"upwards' || {TOTAL} || '"with_callers":' || CAST(with_callers AS STRING) || ',"cyclic":' || CAST(cyclic AS STRING) || ',"cut":' || CAST(cut AS STRING) || ',"entry_points":' || CAST(n AS STRING) || ',"coverage":' || CAST(coverage AS STRING)
      || '}}}},"analysis_limitations":[{{{{"id":"DYNAMIC_DISPATCH","severity":"HIGH"}}}},{{{{"id":"INTERFACE_RESOLUTION","severity":"MEDIUM"}}}},{{{{"id":"FRAMEWORK_CALLS","severity":"MEDIUM"}}}},{{{{"id":"NATIVE_CODE","severity":"LOW"}}}}],"recommendations":' || CASE WHEN len(advice) = 0 THEN '["COMPLETE"]' ELSE CAST(to_json(advice) AS STRING) END || '}}}}' FROM advised) """
).replace("{{{{", "{{").replace("}}}}", "}}")
DOWN_RUN = (
    f"{STATEMENTS}, {NAMES}, seeds AS (SELECT * FROM names WHERE NOT lost AND change IS NOT NULL), dw AS (SELECT w.*, CAST(NULL AS INT) AS line FROM walk w JOIN seeds s ON s.method_id = w.root_id), "
    + tree_sql("dw", "dt", FIELD + SQL_FIELD, "LEFT JOIN stmts y ON y.method_id = n.node_id")
    + f""", sized AS (SELECT root_id, count(*) AS nodes, max(depth) AS depth, count(*) FILTER (is_cyclic) AS cyclic, count(*) FILTER (depth = {DEPTH} AND NOT is_cyclic AND node_id IN (SELECT src FROM g)) AS cut FROM dw GROUP BY root_id),
  summed AS (SELECT count(*) AS total, coalesce(sum(nodes), 0) AS nodes, coalesce(sum(cyclic), 0) AS cyclic, coalesce(sum(cut), 0) AS cut, (SELECT count(*) FROM names WHERE lost AND change IS NOT NULL) AS lost FROM sized),
  down_run AS (SELECT 'chain' AS kind, m.root_id, '{{{{"direction":"downwards","method":' || {METHOD} || ',"stats":' || {STATS} || ',"chain":' || t.doc || '}}}}' AS doc FROM sized m JOIN dt0 t ON t.root_id = m.root_id JOIN names s ON s.method_id = m.root_id
    UNION ALL {FAILED}
    UNION ALL SELECT 'metadata', NULL, '{{{{"direction":"downwards' || {TOTAL} || '"nodes":' || CAST(nodes AS STRING) || ',"cyclic":' || CAST(cyclic AS STRING) || ',"cut":' || CAST(cut AS STRING) || '}}}}' || '}}}}' FROM summed) """
).replace("{{{{", "{{").replace("}}}}", "}}")


@query("P03_upwards_run", UP_RUN + "SELECT * FROM up_run")
def p03_run(f: Facts) -> DataFrame:
    """Metadata, chains with entry points and limits, failures, advice."""
    return run_up(f)


@query("P04_downwards_run", f"{CHA_DOWN}, {DOWN_RUN} SELECT * FROM down_run")
def p04_run(f: Facts) -> DataFrame:
    """Nested chains down to the statements, interface calls resolved."""
    return run_down(f)


@query("P05_bidirectional_run", f"{CHA_DOWN}, {UP_RUN.removeprefix('WITH RECURSIVE ').replace('up AS (', 'up AS (', 1)}, {DOWN_RUN.replace(NAMES + ', seeds AS (SELECT * FROM names WHERE NOT lost AND change IS NOT NULL), ', '')} SELECT 'upwards' AS direction, * FROM up_run UNION ALL SELECT 'downwards', * FROM down_run UNION ALL SELECT 'skipped', 'metadata', NULL, '{{{{\"skipped_unchanged\":' || CAST(count(*) AS STRING) || '}}}}' FROM {{method_f}} WHERE change_type = 'UNCHANGED'".replace("{{{{", "{{").replace("}}}}", "}}"))
def p05_run(f: Facts) -> DataFrame:
    """Both runs of the changed methods, and how many unchanged ones were skipped."""
    skipped = f.method_f.filter("change_type = 'UNCHANGED'").agg(F.count("*").alias("skipped_unchanged"))
    note = skipped.select(F.lit("skipped"), F.lit("metadata"), F.lit(None).cast("bigint"), F.to_json(F.struct("skipped_unchanged")))
    return run_up(f).select(F.lit("upwards").alias("direction"), "*").union(run_down(f).select(F.lit("downwards"), "*")).union(note)


@query("V09_nested_documents", f"{UP_RUN} SELECT root_id, doc FROM up_run WHERE kind = 'chain'")
def v09_nested(f: Facts) -> DataFrame:
    """The chains of one direction, read from a run that was saved by direction and kind: other folders are not opened."""
    path = new_folder(f.spark, "runs")
    run_up(f).withColumn("direction", F.lit("upwards")).write.partitionBy("direction", "kind").option("compression", "gzip").json(path)
    saved = f.spark.read.schema("root_id long, doc string, direction string, kind string").json(path)
    return saved.filter("direction = 'upwards' AND kind = 'chain'").select("root_id", "doc")


GRAPH = f"""{UP}, {NAMES}, apis AS (SELECT m.method_id, c.controller_base_url AS path FROM {{method_f}} m JOIN {{class_f}} c ON c.class_id = m.class_id WHERE m.is_api),
  drawn AS (SELECT root_id, node_id, min(depth) AS level FROM up GROUP BY root_id, node_id),
  parts AS (SELECT root_id, '[' || string_agg('{{{{"id":' || CAST(node_id AS STRING) || ',"name":"' || name || '","category":"' || change_type || '","level":' || CAST(level AS STRING) || coalesce(',"api_path":"' || path || '"', '') || '}}}}', ',' ORDER BY node_id) || ']' AS nodes,
    CAST(to_json(list_sort(list(DISTINCT change_type))) AS STRING) AS categories, CAST(to_json(coalesce(list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)), [])) AS STRING) AS apis,
    '[' || string_agg('{{{{"change":"' || change || '","id":' || CAST(node_id AS STRING) || '}}}}', ',' ORDER BY change, node_id) || ']' AS changes
    FROM drawn JOIN names x ON x.method_id = node_id LEFT JOIN apis a ON a.method_id = node_id GROUP BY root_id),
  lines AS (SELECT root_id, '[' || string_agg('{{{{"source":' || CAST(parent_id AS STRING) || ',"target":' || CAST(node_id AS STRING) || '}}}}', ',' ORDER BY parent_id, node_id) || ']' AS links FROM (SELECT DISTINCT root_id, parent_id, node_id FROM up WHERE parent_id <> node_id) z GROUP BY root_id)
  SELECT p.root_id, '{{{{"nodes":' || nodes || ',"links":' || coalesce(links, '[]') || ',"categories":' || categories || ',"impacted_api_list":' || apis || ',"method_changes":' || changes || '}}}}' AS doc FROM parts p LEFT JOIN lines l ON l.root_id = p.root_id""".replace("{{{{", "{{").replace("}}}}", "}}")


def graphs(f: Facts) -> DataFrame:
    levels = graph.chain_levels(f.method_f.filter("change_type <> 'UNCHANGED'").select(F.col("method_id").alias("root_id")), reverse(f), DEPTH, ranked=False)
    api = f.method_f.filter("is_api").join(f.class_f, "class_id").select(F.col("method_id").alias("node_id"), F.col("controller_base_url").alias("api_path"))
    return results.graph_documents(levels, results.named(f.method_f, f.class_f).select("node_id", "name", "change"), api)


@query("K13_impact_graphs", GRAPH)
def k13_graphs(f: Facts) -> DataFrame:
    """The graph of each changed method: nodes, links, categories, impacted APIs, changes."""
    return graphs(f)


@query("K10_saved_graphs", f"SELECT root_id, json_array_length(doc, '$.nodes')::BIGINT AS nodes, json_array_length(doc, '$.links')::BIGINT AS links, json_array_length(doc, '$.impacted_api_list')::BIGINT AS apis, doc ->> '$.nodes[0].name' AS first FROM ({GRAPH}) x")
def k10_saved(f: Facts) -> DataFrame:
    """Results saved as JSON documents and loaded again by their fields."""
    path = new_folder(f.spark, "graphs")
    graphs(f).select(F.concat(F.lit('{"root_id":'), F.col("root_id").cast("string"), F.lit(","), F.substr("doc", F.lit(2))).alias("value")).write.option("compression", "gzip").text(path)
    read = documents.load_json(f.spark, path, "root_id long, nodes array<struct<id:long,name:string>>, links array<struct<source:long,target:long>>, impacted_api_list array<string>")
    size = lambda c: F.size(c).cast("long")
    return read.select("root_id", size("nodes").alias("nodes"), size("links").alias("links"), size("impacted_api_list").alias("apis"), F.col("nodes")[0]["name"].alias("first"))


@query("K12_downwards_report", f"""{CHA_DOWN}, {NAMES}, wanted AS (SELECT w.* FROM walk w),
  lines AS (SELECT root_id, seen, 0 AS place, repeat(chr(9), depth) || name || ' (' || change_type || ')' AS line FROM wanted JOIN names x ON x.method_id = node_id
    UNION ALL SELECT root_id, seen, stmt_id + 1, repeat(chr(9), depth + 1) || '| ' || rpad(left(sql_type || ' ' || regexp_replace(sql_content, '\\s+', ' ', 'g'), {BOX}), {BOX}, ' ') || ' |' FROM wanted JOIN {{stmt_f}} s ON s.linked_method_id = node_id)
  SELECT root_id, string_agg(line, chr(10) ORDER BY seen, place) AS report FROM lines GROUP BY root_id""")
def k12_report(f: Facts) -> DataFrame:
    """The downwards report of each changed method, with a box a statement below its data access method."""
    edges = steps_down(f)
    levels = graph.chain_levels(f.method_f.filter("change_type <> 'UNCHANGED'").select(F.col("method_id").alias("root_id")), edges, DEPTH, ranked=False)
    names = written(results.named(f.method_f, f.class_f).select("node_id", "name", "change"))
    return results.boxed_report(levels, names, linked_statements(f), BOX)
