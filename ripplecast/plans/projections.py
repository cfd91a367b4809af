"""Queries on scans and filters (S*, F*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import lookup
from ..registry import query


@query("S09_table_scan", "SELECT method_id, method_name, start_line, end_line FROM {method_f}")
def s09(f: Facts) -> DataFrame:
    return f.method_f.select("method_id", "method_name", "start_line", "end_line")


@query("S14_ref_validation", "SELECT t.task_id, CASE WHEN r.tag IS NOT NULL THEN 'tag' WHEN h.prefix IS NOT NULL THEN 'commit' ELSE 'unknown' END AS ref FROM {task_f} t LEFT JOIN (SELECT DISTINCT git_url, tag_old AS tag FROM {task_f}) r ON r.git_url = t.git_url AND r.tag = t.tag_new LEFT JOIN (SELECT DISTINCT left(sha256(git_url), 8) AS prefix FROM {task_f} WHERE status = 'completed') h ON starts_with(sha256(t.git_url), h.prefix)")
def s14(f: Facts) -> DataFrame:
    """A version against the refs of its repository: a tag of that name, else a commit that begins as it does."""
    tags = f.task_f.select("git_url", F.col("tag_old").alias("tag_new")).distinct().withColumn("is_tag", F.lit(True))
    commits = f.task_f.filter("status = 'completed'").select(F.substring(F.sha2("git_url", 256), 1, 8).alias("prefix")).distinct().withColumn("is_commit", F.lit(True))
    rows = f.task_f.withColumn("prefix", F.substring(F.sha2("git_url", 256), 1, 8)).join(tags, ["git_url", "tag_new"], "left").join(commits, "prefix", "left")
    return rows.select("task_id", F.when(F.col("is_tag"), "tag").when(F.col("is_commit"), "commit").otherwise("unknown").alias("ref"))


@query("S14_ref_prefixes", """WITH asked AS (SELECT task_id, git_url, CASE WHEN task_id % 3 = 0 THEN tag_new ELSE left(sha256(CAST(task_id + task_id % 3 - 1 AS STRING)), CAST(2 + task_id % 5 AS INT)) END AS ref FROM {task_f}),
  tags AS (SELECT DISTINCT git_url, tag_old AS ref FROM {task_f}), commits AS (SELECT DISTINCT git_url, sha256(CAST(task_id AS STRING)) AS hash FROM {task_f} WHERE status = 'completed'),
  hits AS (SELECT a.task_id, count(*) AS n, min(hash) AS hash FROM asked a JOIN commits c ON c.git_url = a.git_url AND starts_with(c.hash, a.ref) GROUP BY a.task_id)
  SELECT a.task_id, CASE WHEN t.ref IS NOT NULL THEN 'tag' WHEN h.n = 1 THEN 'commit' WHEN h.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS kind, CASE WHEN t.ref IS NULL AND h.n = 1 THEN h.hash END AS hash, coalesce(h.n, 0) AS hits
  FROM asked a LEFT JOIN tags t ON t.git_url = a.git_url AND t.ref = a.ref LEFT JOIN hits h ON h.task_id = a.task_id""")
def s14_prefixes(f: Facts) -> DataFrame:
    """A version against the refs of its repository: a tag of that name, else the one commit whose hash begins with it; of several
    commits none is chosen."""
    digest = lambda x: F.sha2(x.cast("string"), 256)
    n = F.col("task_id")
    asked = f.task_f.select("task_id", "git_url", F.when(n % 3 == 0, F.col("tag_new")).otherwise(F.substring(digest(n + n % 3 - 1), F.lit(1), (2 + n % 5).cast("int"))).alias("ref"))
    tags = f.task_f.select("git_url", F.col("tag_old").alias("ref")).distinct().withColumn("is_tag", F.lit(True))
    commits = f.task_f.filter("status = 'completed'").select("git_url", digest(n).alias("hash")).distinct()
    hits = lookup.prefix_counts(asked, commits, "git_url", "ref", "hash").groupBy("task_id").agg(F.sum("n").alias("n"), F.min("hash").alias("hash"))
    rows = asked.join(tags, ["git_url", "ref"], "left").join(hits, "task_id", "left")
    kind = F.when(F.col("is_tag"), "tag").when(F.col("n") == 1, "commit").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return rows.select("task_id", kind.alias("kind"), F.when(kind == "commit", F.col("hash")).alias("hash"), F.coalesce("n", F.lit(0)).alias("hits"))


ENDINGS = "CASE class_id % 4 WHEN 0 THEN filepath WHEN 1 THEN replace(filepath, 'src/main/', '') WHEN 2 THEN replace(filepath, 'src/main/java/', '') ELSE replace(filepath, 'src/main/java/c', '') END"


@query("F02_suffix_join", f"SELECT p.path, c.class_id FROM (SELECT DISTINCT {ENDINGS} AS path FROM {{class_f}}) p JOIN {{class_f}} c ON c.filepath = p.path OR ends_with(c.filepath, '/' || p.path)")
def f02_join(f: Facts) -> DataFrame:
    """Files by the ends of their paths, at slashes, without comparing each pair."""
    paths = f.class_f.select(F.expr(ENDINGS).alias("path")).distinct()
    return lookup.suffix_join(paths, f.class_f.select("class_id", "filepath"), "path", "filepath").select("path", "class_id")


@query("F01_equality", "SELECT method_id FROM {method_v} WHERE project_id = 1 AND method_name = 'getItem0'")
def f01(f: Facts) -> DataFrame:
    return f.method_v.filter("project_id = 1 AND method_name = 'getItem0'").select("method_id")


@query("F02_path_suffix", "SELECT class_id, filepath FROM {class_f} WHERE filepath LIKE '%5.java'")
def f02(f: Facts) -> DataFrame:
    return f.class_f.filter(F.col("filepath").endswith("5.java")).select("class_id", "filepath")


@query("F03_name_suffix", "SELECT class_id, class_name FROM {class_f} WHERE lower(class_name) LIKE '%controller' OR lower(class_name) LIKE '%mapper'")
def f03(f: Facts) -> DataFrame:
    name = F.lower("class_name")
    return f.class_f.filter(name.endswith("controller") | name.endswith("mapper")).select("class_id", "class_name")


@query("F04_package_suffix", "SELECT class_id, package_name FROM {class_f} WHERE package_name LIKE '%_1'")
def f04(f: Facts) -> DataFrame:
    return f.class_f.filter(F.substring("package_name", -1, 1) == "1").filter(F.length("package_name") >= 2).select("class_id", "package_name")


@query("F05_in_list", "SELECT method_id FROM {method_f} WHERE change_type IN ('ADDED', 'DELETED')")
def f05(f: Facts) -> DataFrame:
    return f.method_f.filter(F.col("change_type").isin("ADDED", "DELETED")).select("method_id")


@query("F06_line_in_range", "SELECT method_id FROM {method_f} WHERE start_line <= 105 AND end_line >= 105")
def f06(f: Facts) -> DataFrame:
    return f.method_f.filter("start_line <= 105 AND end_line >= 105").select("method_id")


@query("F07_interval_overlap", "SELECT method_id FROM {method_f} WHERE start_line <= 300 AND end_line >= 200")
def f07(f: Facts) -> DataFrame:
    return f.method_f.filter("start_line <= 300 AND end_line >= 200").select("method_id")


@query("F08_changed", "SELECT method_id, change_type FROM {method_f} WHERE change_type <> 'UNCHANGED'")
def f08(f: Facts) -> DataFrame:
    return f.method_f.filter("change_type <> 'UNCHANGED'").select("method_id", "change_type")


@query("F09_json_exists", "SELECT event_id FROM {events} WHERE json_extract(props, '$.k') IS NOT NULL")
def f09(f: Facts) -> DataFrame:
    return f.events.filter(F.get_json_object("props", "$.k").isNotNull()).select("event_id")


@query("F10_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events} WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def f10(f: Facts) -> DataFrame:
    return f.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).filter("k >= 50")


@query("F11_many_paths", "SELECT event_id FROM {events} WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (SELECT s_suppkey FROM {supplier})")
def f11(f: Facts) -> DataFrame:
    keys = f.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("s_suppkey"))
    return keys.join(f.supplier.select("s_suppkey"), "s_suppkey", "left_semi").select("event_id")


@query("F13_empty_or_equal", "SELECT task_id FROM {task_f} WHERE project_code = '' OR project_code = '1-URGENT'")
def f13(f: Facts) -> DataFrame:
    return f.task_f.filter((F.col("project_code") == "") | (F.col("project_code") == "1-URGENT")).select("task_id")


@query("F14_coalesced", "SELECT task_id FROM {task_f} WHERE coalesce(project_code, '') = ''")
def f14(f: Facts) -> DataFrame:
    return f.task_f.filter(F.coalesce("project_code", F.lit("")) == "").select("task_id")


@query("F15_recent_active", "SELECT task_id FROM {task_f} WHERE status IN ('pending', 'running') AND created_at + INTERVAL 30 MINUTE > (SELECT max(created_at) FROM {task_f})")
def f15(f: Facts) -> DataFrame:
    """Tasks that are active and less than 30 minutes older than the newest one."""
    now = f.task_f.agg(F.max("created_at").alias("now"))
    return f.task_f.filter(F.col("status").isin("pending", "running")).join(F.broadcast(now), F.expr("created_at + INTERVAL 30 MINUTES > now")).select("task_id")


@query("F16_package_prefix", "SELECT class_id FROM {class_f} WHERE regexp_matches(package_name, '^(com|cn|net)\\.')")
def f16(f: Facts) -> DataFrame:
    return f.class_f.filter(F.col("package_name").rlike("^(com|cn|net)\\.")).select("class_id")


@query("F17_annotation_member", "SELECT class_id FROM {class_f} WHERE annotations LIKE '%\"Data\"%'")
def f17(f: Facts) -> DataFrame:
    return f.class_f.filter(F.exists(F.from_json("annotations", "array<struct<name:string>>"), lambda a: a["name"].isin("Data", "Getter", "Setter"))).select("class_id")


@query("F18_skip_unchanged", "SELECT count(*) FILTER (change_type = 'UNCHANGED') AS skipped, count(*) FILTER (change_type <> 'UNCHANGED') AS kept FROM {method_f}")
def f18(f: Facts) -> DataFrame:
    return f.method_f.agg(F.count_if(F.col("change_type") == "UNCHANGED").alias("skipped"), F.count_if(F.col("change_type") != "UNCHANGED").alias("kept"))


@query("F19_name_search", "SELECT method_id FROM {method_f} WHERE strpos(lower(method_name), lower('BATCH')) > 0")
def f19(f: Facts) -> DataFrame:
    return f.method_f.filter(F.lower("method_name").contains("BATCH".lower())).select("method_id")


@query("F20_api_shape", "SELECT method_id AS id, method_name AS name, change_type AS status FROM {method_f}")
def f20(f: Facts) -> DataFrame:
    return f.method_f.select(F.col("method_id").alias("id"), F.col("method_name").alias("name"), F.col("change_type").alias("status"))
