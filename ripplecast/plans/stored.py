"""Mutations as writes to a versioned table (K01-K07, K14-K16): the rows are those that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import lookup
from ..registry import query
from ..session import new_folder
from ..sources.versions import VersionedTable
from .results import GRAPH, graphs


def stored(f: Facts, rows: DataFrame, keys: list[str]) -> VersionedTable:
    """A table that holds rows as its first version."""
    table = VersionedTable(f.spark, new_folder(f.spark, "table"), keys)
    table.append(rows)
    return table


def both(table: VersionedTable) -> DataFrame:
    """The first version and the last one."""
    return table.read(1).withColumn("version", F.lit(1)).union(table.read().withColumn("version", F.lit(2)))


@query("K01_stored_append", "SELECT method_id, project_id, 1 AS version FROM {method_v} UNION ALL SELECT method_id, project_id, 2 FROM {method_v} UNION ALL SELECT method_id, 2, 2 FROM {method_f}")
def k01_stored(f: Facts) -> DataFrame:
    table = stored(f, f.method_v.select("method_id", "project_id"), ["method_id"])
    table.append(f.method_f.select("method_id", F.lit(2).alias("project_id")))
    return both(table)


@query("K02_stored_absent", """WITH old AS (SELECT class_id, method_name, min(method_id) AS method_id FROM {method_v} WHERE project_id = 1 GROUP BY class_id, method_name),
  new AS (SELECT class_id, method_name, min(method_id) AS method_id FROM {method_f} GROUP BY class_id, method_name)
  SELECT *, 1 AS version FROM old UNION ALL SELECT *, 2 FROM old UNION ALL SELECT n.*, 2 FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.class_id = n.class_id AND o.method_name = n.method_name)""")
def k02_stored(f: Facts) -> DataFrame:
    """Inserts only those whose keys are not there."""
    first = lambda rows: rows.groupBy("class_id", "method_name").agg(F.min("method_id").alias("method_id"))
    table = stored(f, first(f.method_v.filter("project_id = 1")), ["class_id", "method_name"])
    table.insert_absent(first(f.method_f))
    return both(table)


@query("K03_stored_projects", """WITH p AS (SELECT git_url, tag_old, tag_new, min(task_id) AS project_id FROM {task_f} WHERE status = 'completed' GROUP BY git_url, tag_old, tag_new),
  n AS (SELECT git_url, tag_old, tag_new, min(task_id) AS project_id FROM {task_f} GROUP BY git_url, tag_old, tag_new)
  SELECT *, 1 AS version FROM p UNION ALL SELECT *, 2 FROM p UNION ALL SELECT n.*, 2 FROM n WHERE (git_url, tag_old, tag_new) NOT IN (SELECT (git_url, tag_old, tag_new) FROM p)""")
def k03_stored(f: Facts) -> DataFrame:
    """Projects by address and tags: those that are there keep their ids."""
    keys = ["git_url", "tag_old", "tag_new"]
    first = lambda rows: rows.groupBy(*keys).agg(F.min("task_id").alias("project_id"))
    table = stored(f, first(f.task_f.filter("status = 'completed'")), keys)
    table.insert_absent(first(f.task_f))
    return both(table)


@query("K04_stored_replace", """SELECT class_id, method_id, 1 AS version FROM {method_v} WHERE project_id = 0 UNION ALL SELECT class_id, method_id, 2 FROM {method_v} WHERE project_id = 1
  UNION ALL SELECT class_id, method_id, 2 FROM {method_v} WHERE project_id = 0 AND class_id NOT IN (SELECT class_id FROM {method_v} WHERE project_id = 1)""")
def k04_stored(f: Facts) -> DataFrame:
    """Deletes the methods of each class of the increment, then inserts its own."""
    v = f.method_v.select("class_id", "method_id", "project_id")
    table = stored(f, v.filter("project_id = 0").drop("project_id"), ["class_id"])
    table.replace(v.filter("project_id = 1").drop("project_id"))
    return both(table)


@query("K05_stored_update", """SELECT method_id, brand, change_type, 1 AS version FROM {method_f} UNION ALL SELECT method_id, brand, CASE WHEN brand = 'Brand#11' OR method_id % 10 = 0 THEN 'MODIFIED' ELSE change_type END, 2 FROM {method_f}""")
def k05_stored(f: Facts) -> DataFrame:
    table = stored(f, f.method_f.select("method_id", "brand", "change_type"), ["method_id"])
    table.update("brand = 'Brand#11' OR method_id % 10 = 0", {"change_type": F.lit("MODIFIED")})
    return both(table)


@query("K06_stored_statements", """WITH o AS (SELECT class_id, method_id, max(stmt_id) AS stmt_id FROM {stmt_f} WHERE mapper_type = 'XML' GROUP BY class_id, method_id), n AS (SELECT class_id, method_id, max(stmt_id) AS stmt_id FROM {stmt_f} WHERE mapper_type <> 'XML' GROUP BY class_id, method_id)
  SELECT *, 1 AS version FROM o UNION ALL SELECT *, 2 FROM n UNION ALL SELECT o.*, 2 FROM o WHERE (class_id, method_id) NOT IN (SELECT (class_id, method_id) FROM n)""")
def k06_stored(f: Facts) -> DataFrame:
    """Statements of annotations take the place of those from files under one full name."""
    last = lambda rows: rows.groupBy("class_id", "method_id").agg(F.max("stmt_id").alias("stmt_id"))
    table = stored(f, last(f.stmt_f.filter("mapper_type = 'XML'")), ["class_id", "method_id"])
    table.replace(last(f.stmt_f.filter("mapper_type <> 'XML'")))
    return both(table)


CACHE = "analysis_type, direction, baseline, version, class_name, method_name, change_type"


@query("K07_stored_cache", f"""WITH c AS (SELECT *, created_at <= 2 AS early FROM {{cache_f}}), o AS (SELECT {CACHE}, max(id) AS id FROM c WHERE early GROUP BY {CACHE}), n AS (SELECT {CACHE}, max(id) AS id FROM c WHERE NOT early GROUP BY {CACHE})
  SELECT 1 AS at, id FROM o UNION ALL SELECT 2, id FROM n UNION ALL SELECT 2, id FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE {" AND ".join(f"n.{k} IS NOT DISTINCT FROM o.{k}" for k in CACHE.split(", "))})""")
def k07_stored(f: Facts) -> DataFrame:
    """Insert or replace by seven keys, some of them null."""
    keys = CACHE.split(", ")
    last = lambda rows: lookup.first_per_key(rows, keys, [F.desc("id")]).select(*keys, "id")
    table = stored(f, last(f.cache_f.filter("created_at <= 2")), keys)
    table.replace(last(f.cache_f.filter("created_at > 2")))
    return table.read(1).select(F.lit(1).alias("at"), "id").union(table.read().select(F.lit(2), "id"))


@query("K15_stored_delete", "SELECT task_id, status, 1 AS version FROM {task_f} UNION ALL SELECT task_id, status, 2 FROM {task_f} WHERE NOT (status = 'completed' AND max_depth = 0)")
def k15_stored(f: Facts) -> DataFrame:
    table = stored(f, f.task_f.select("task_id", "status"), ["task_id"])
    table.delete(f.task_f.filter("status = 'completed' AND max_depth = 0").select("task_id"))
    return both(table)


@query("K14_stored_status", "SELECT task_id, status, CASE WHEN status = 'pending' THEN 'out/' || CAST(task_id AS STRING) END AS output_dir, 1 AS version FROM {task_f} UNION ALL SELECT task_id, CASE status WHEN 'pending' THEN 'running' ELSE status END, CASE WHEN status = 'pending' THEN 'out/' || CAST(task_id AS STRING) END, 2 FROM {task_f}")
def k14_stored(f: Facts) -> DataFrame:
    """Pending tasks start: a null output folder in the update keeps the stored one."""
    table = stored(f, f.task_f.select("task_id", "status", F.expr("CASE WHEN status = 'pending' THEN 'out/' || CAST(task_id AS STRING) END").alias("output_dir")), ["task_id"])
    given = F.lit(None).cast("string")
    table.update("status = 'pending'", {"status": F.lit("running"), "output_dir": F.coalesce(given, F.col("output_dir"))})
    return both(table)


@query("K16_stored_results", "SELECT task_id, result_id, 1 AS version FROM {llm_f} WHERE kind = 'user' UNION ALL SELECT task_id, result_id, 2 FROM {llm_f}")
def k16_stored(f: Facts) -> DataFrame:
    rows = f.llm_f.select("task_id", "result_id", "kind")
    table = stored(f, rows.filter("kind = 'user'").drop("kind"), ["task_id"])
    table.append(rows.filter("kind <> 'user'").drop("kind"))
    return both(table)


@query("S15_stored_method_index", """SELECT method_id, class_id, method_name, parameters FROM {method_f} WHERE (class_id, method_name) IN (SELECT (class_id, method_name) FROM {method_f} WHERE method_id = (SELECT max(method_id) FROM {method_f}))""")
def s15_index(f: Facts) -> DataFrame:
    """A stored index of methods by class and name, asked for one method's overloads: one bucket is read."""
    rows = f.method_f.select("method_id", "class_id", "method_name", "parameters")
    asked = rows.agg(F.max_by(F.struct("class_id", "method_name"), "method_id").alias("m")).select("m.*")
    return stored(f, rows, ["class_id", "method_name"]).lookup(asked)


@query("S15_stored_chain", f"SELECT * FROM ({GRAPH}) x WHERE root_id = (SELECT max(method_id) FROM {{method_f}} WHERE change_type = 'MODIFIED')")
def s15_chain(f: Facts) -> DataFrame:
    """The stored graphs of all changed methods, asked for one of them."""
    asked = f.method_f.filter("change_type = 'MODIFIED'").agg(F.max("method_id").alias("root_id"))
    return stored(f, graphs(f), ["root_id"]).lookup(asked)
