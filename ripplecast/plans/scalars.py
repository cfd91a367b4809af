"""Queries on scalar functions (C*), and entry classification (E*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions import names as N
from ..operators import entries
from ..registry import query

TAGS = """SELECT task_id, CASE task_id % 5 WHEN 0 THEN 'mall_SHAb42d_20231225_0' || CAST(task_id % 9 AS STRING) WHEN 1 THEN 'v' || CAST(task_id % 99 AS STRING)
  WHEN 2 THEN 'SHA12ab_20260101_0' || CAST(task_id % 9 AS STRING) WHEN 3 THEN 'MIX_PIPE_ST_00.03.05_SUMMER_' || CAST(task_id AS STRING) || '_20260506_01' ELSE 'dd6569c3558f79af5b21aad601349e0f029b9a6d' END AS tag FROM {task_f}"""


def tags(f: Facts) -> DataFrame:
    return f.spark.sql(TAGS, task_f=f.task_f)


@query("C01_short_tag", f"""SELECT task_id, tag, CASE WHEN tag IS NULL OR tag = '' THEN '' WHEN regexp_matches(tag, '(?i)^SHA[0-9a-f]{{{{4}}}}_[\\w.\\-]{{{{11}}}}$') OR length(tag) <= 11 THEN tag
  WHEN regexp_extract(tag, '(?i)(SHA[0-9a-f]{{{{4}}}}_[\\w.\\-]{{{{11}}}})', 1) <> '' THEN regexp_extract(tag, '(?i)(SHA[0-9a-f]{{{{4}}}}_[\\w.\\-]{{{{11}}}})', 1)
  WHEN regexp_matches(tag, '(?i)^[0-9a-f]{{{{40}}}}$') THEN substr(tag, 1, 8) ELSE 'SHA' || substr(sha256(tag), 1, 4) || '_' || right(tag, 11) END AS short FROM ({TAGS}) x""")
def c01(f: Facts) -> DataFrame:
    return tags(f).select("task_id", "tag", N.short_tag(F.col("tag")).alias("short"))


@query("C02_signature", "SELECT method_id, method_name || '(' || parameters || ')' AS signature FROM {method_f}")
def c02(f: Facts) -> DataFrame:
    return f.method_f.select("method_id", N.signature(F.col("method_name"), N.split_types(F.col("parameters"))).alias("signature"))


@query("C03_signature_types", """SELECT method_id, CASE parameters WHEN '' THEN 0 WHEN 'Long' THEN 1 WHEN 'java.lang.Long' THEN 1 ELSE 2 END AS n_types,
  CASE parameters WHEN 'String,Map<String,Integer>' THEN 'String | Map<String,Integer>' WHEN 'int,List<String>' THEN 'int | List<String>' ELSE parameters END AS types FROM {method_f}""")
def c03(f: Facts) -> DataFrame:
    types = N.types_of_signature(F.concat("method_name", F.lit("("), "parameters", F.lit(")")))
    return f.method_f.select("method_id", F.size(types).alias("n_types"), F.array_join(types, " | ").alias("types"))


PAIRS = "SELECT a.method_id AS a_id, b.method_id AS b_id, a.parameters AS pa, b.parameters AS pb FROM {method_f} a JOIN {edge_f} ON caller_id = a.method_id JOIN {method_f} b ON callee_id = b.method_id"


@query("C04_types_match", f"SELECT a_id, b_id, replace(pa, 'java.lang.', '') = replace(pb, 'java.lang.', '') AS same FROM ({PAIRS}) x")
def c04(f: Facts) -> DataFrame:
    x = f.spark.sql(PAIRS, method_f=f.method_f, edge_f=f.edge_f)
    return x.select("a_id", "b_id", N.types_match(N.split_types(F.col("pa")), N.split_types(F.col("pb"))).alias("same"))


@query("C05_name_split", """SELECT class_id, regexp_extract(q, '([^.]*)$', 1) AS simple, regexp_replace(q, '\\.[^.]*$', '') AS package
  FROM (SELECT class_id, package_name || '.' || class_name AS q FROM {class_f}) x""")
def c05(f: Facts) -> DataFrame:
    q = F.concat_ws(".", "package_name", "class_name")
    return f.class_f.select("class_id", N.simple_name(q).alias("simple"), N.package_name(q).alias("package"))


@query("C06_type_similarity", f"""SELECT a_id, b_id, CAST(CASE WHEN pa = pb THEN CASE pa WHEN '' THEN 0 WHEN 'Long' THEN 1 WHEN 'java.lang.Long' THEN 1 ELSE 2 END ELSE 0 END AS BIGINT) AS points FROM ({PAIRS}) x""")
def c06(f: Facts) -> DataFrame:
    x = f.spark.sql(PAIRS, method_f=f.method_f, edge_f=f.edge_f)
    return x.select("a_id", "b_id", N.similarity(N.split_types(F.col("pa")), N.split_types(F.col("pb"))).alias("points"))


@query("C08_boxed_switch", """SELECT class_id, word, CASE word WHEN 'int' THEN 'Integer' WHEN 'Integer' THEN 'int' WHEN 'long' THEN 'Long' ELSE word END AS switched
  FROM (SELECT class_id, CASE class_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'Integer' WHEN 2 THEN 'long' ELSE 'List' END AS word FROM {class_f}) x""")
def c08(f: Facts) -> DataFrame:
    word = F.expr("CASE class_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'Integer' WHEN 2 THEN 'long' ELSE 'List' END")
    return f.class_f.select("class_id", word.alias("word"), N.boxed_switch(word).alias("switched"))


@query("C09_literal_type", """SELECT event_id, CASE WHEN lower(v) IN ('true', 'false') THEN 'Boolean' WHEN regexp_matches(v, '^[0-9]+$') THEN 'Int' ELSE 'String' END AS kind
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'True' ELSE event_type END AS v FROM {events}) x""")
def c09(f: Facts) -> DataFrame:
    v = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'True' ELSE event_type END")
    return f.events.select("event_id", N.literal_type(v).alias("kind"))


@query("C10_basic_type", "SELECT event_id, CASE WHEN event_type = 'int' THEN event_type ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS basic FROM {events}")
def c10(f: Facts) -> DataFrame:
    return f.events.select("event_id", N.canonical_basic(F.col("event_type")).alias("basic"))


@query("C11_change_type", """SELECT method_id, CASE WHEN upper(t) IN ('ADDED', 'MODIFIED', 'DELETED', 'UNCHANGED') THEN upper(t) ELSE 'UNKNOWN' END AS parsed
  FROM (SELECT method_id, CASE method_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE lower(change_type) END AS t FROM {method_f}) x""")
def c11(f: Facts) -> DataFrame:
    return f.method_f.select("method_id", N.change_type(F.expr("CASE method_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE lower(change_type) END")).alias("parsed"))


@query("C12_api_paths", """SELECT method_id, '[' || CASE method_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END || ']/c' || CAST(m.class_id AS STRING) || '/' || method_name AS path
  FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id WHERE is_api AND is_controller""")
def c12(f: Facts) -> DataFrame:
    x = f.method_f.filter("is_api").join(f.class_f.filter("is_controller").select("class_id", "controller_base_url"), "class_id")
    verb = F.when(F.col("method_id") % 2 == 0, "GET").otherwise("POST")
    return x.select("method_id", N.api_paths(F.col("controller_base_url"), F.array(F.concat(F.lit("/"), "method_name")), verb)[0].alias("path"))


@query("C23_api_decode", """SELECT class_id, CASE class_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN '/plain' ELSE '' END AS decoded FROM {class_f}""")
def c23(f: Facts) -> DataFrame:
    text = F.expr("""CASE class_id % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '/plain' ELSE '' END""")
    return f.class_f.select("class_id", F.array_join(N.decoded_list(text), ",").alias("decoded"))


@query("C25_clean_thinking", """SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS cleaned FROM (SELECT doc_id, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM {documents}) x""")
def c25(f: Facts) -> DataFrame:
    dressed = F.concat(F.lit("<think>a<think>b</think>c</think>"), F.col("text"), F.lit("<think>"))
    return f.documents.select("doc_id", N.without_thinking(dressed).alias("cleaned"))


@query("C26_short_label", """SELECT method_id, CASE WHEN length(p) < 30 THEN 'C.m(' || p || ')' ELSE 'C.m(—, —)' END AS label
  FROM (SELECT method_id, 'Type' || documentation || ' a, Other b' AS p FROM {method_f} WHERE documentation IS NOT NULL AND strpos(documentation, '(') = 0 AND strpos(documentation, ',') = 0) x""")
def c26(f: Facts) -> DataFrame:
    rows = f.method_f.filter("documentation is not null and instr(documentation, '(') = 0 and instr(documentation, ',') = 0")
    return rows.select("method_id", N.short_label(F.concat(F.lit("C.m(Type"), "documentation", F.lit(" a, Other b)"))).alias("label"))


SIGN = "'  ' || chr(128221)"
LABELS = f"""SELECT method_id, c.class_name || '.' || m.method_name AS head, CASE WHEN method_id % 2 = 1 AND parameters <> '' THEN parameters || ', ' || parameters ELSE parameters END AS p,
  coalesce({SIGN} || documentation || ' (see a, b)', '') AS doc FROM {{method_f}} m JOIN {{class_f}} c ON c.class_id = m.class_id"""


@query("C26_tree_labels", f"""SELECT method_id, head || '(' || CASE WHEN length(p) < 30 THEN p ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(p, '\\s*,\\s*'), lambda x: trim(x) <> ''), lambda x: '—'), ', ') END || ')' || CASE WHEN length(doc) > 42 THEN left(doc, 42) || '...' ELSE doc END AS label
  FROM ({LABELS}) x""")
def c26_labels(f: Facts) -> DataFrame:
    """Labels of all methods with their documentation, which holds brackets and commas of its own."""
    p = F.when((F.col("method_id") % 2 == 1) & (F.col("parameters") != ""), F.concat("parameters", F.lit(", "), "parameters")).otherwise(F.col("parameters"))
    doc = F.coalesce(F.concat(F.lit(N.DOC_SIGN), "documentation", F.lit(" (see a, b)")), F.lit(""))
    rows = f.method_f.join(f.class_f.select("class_id", "class_name"), "class_id")
    return rows.select("method_id", N.tree_label(F.concat("class_name", F.lit("."), "method_name", F.lit("("), p, F.lit(")"), doc)).alias("label"))


@query("C28_wide_labels", """SELECT method_id, CAST(length(label) + length(regexp_replace(label, '[^\\x{{1F001}}-\\x{{10FFFF}}]', '', 'g')) AS INT) AS width FROM (SELECT method_id, method_name || repeat(chr(128221), CAST(method_id % 4 AS INT)) || repeat(chr(127881) || 'x', CAST(class_id % 3 AS INT)) || '漢字é' AS label FROM {method_f}) x""")
def c28_wide(f: Facts) -> DataFrame:
    """Widths of labels with none, one and several wide characters, and others beyond ASCII that count once."""
    label = F.concat("method_name", F.repeat(F.lit("\U0001f4dd"), (F.col("method_id") % 4).cast("int")), F.repeat(F.lit("\U0001f389x"), (F.col("class_id") % 3).cast("int")), F.lit("漢字é"))
    return f.method_f.select("method_id", N.display_width(label).alias("width"))


@query("C27_truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS cut FROM {documents}")
def c27(f: Facts) -> DataFrame:
    return f.documents.select("doc_id", N.cut(F.col("text")).alias("cut"))


@query("C28_display_width", "SELECT doc_id, CAST(length(text) + 2 AS INT) AS width FROM {documents}")
def c28(f: Facts) -> DataFrame:
    return f.documents.select("doc_id", N.display_width(F.concat("text", F.lit("\U0001f4dd"))).alias("width"))


@query("C29_first_lines", """SELECT caller_id, CASE WHEN len(ls) > 3 THEN array_to_string(ls[1:3], ', ') || '...(+' || CAST(len(ls) - 3 AS STRING) || ')' ELSE array_to_string(ls, ', ') END AS lines
  FROM (SELECT caller_id, list_sort(list(DISTINCT line)) AS ls FROM {call_f} GROUP BY caller_id) x""")
def c29(f: Facts) -> DataFrame:
    return f.call_f.groupBy("caller_id").agg(N.first_lines(F.array_sort(F.collect_set("line"))).alias("lines"))


@query("C30_project_name", "SELECT task_id, regexp_extract(git_url, '/([^/]*)\\.git$', 1) AS project FROM {task_f}")
def c30(f: Facts) -> DataFrame:
    return f.task_f.select("task_id", N.project_of_url(F.col("git_url")).alias("project"))


@query("C31_progress", "SELECT task_id, round(0.05 + 0.9 * max(result_id) / 20.0, 6) AS progress FROM {llm_f} GROUP BY task_id")
def c31(f: Facts) -> DataFrame:
    return f.llm_f.groupBy("task_id").agg(F.round(F.lit(0.05) + 0.9 * F.max("result_id") / 20.0, 6).alias("progress"))


@query("C32_retry_delay", "SELECT event_id, CAST(5 * power(2, event_id % 3) * CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS delay FROM {events}")
def c32(f: Facts) -> DataFrame:
    return f.events.select("event_id", (5 * F.pow(F.lit(2), F.col("event_id") % 3) * F.when(F.col("event_type") == "error", 2).otherwise(1)).cast("long").alias("delay"))


@query("C33_result_path", "SELECT task_id, 'results/' || regexp_extract(git_url, '/([^/]*)\\.git$', 1) || '_' || tag_old || '/' || tag_new || '/upwards.json.gz' AS path FROM {task_f}")
def c33(f: Facts) -> DataFrame:
    return f.task_f.select("task_id", N.version_path(F.lit("results"), N.project_of_url(F.col("git_url")), F.col("tag_old"), F.col("tag_new"), F.lit("upwards.json.gz")).alias("path"))


@query("C35_change_prompt", """SELECT method_id, CASE change_type WHEN 'ADDED' THEN 'New: ' || method_name WHEN 'DELETED' THEN 'Removed: ' || method_name WHEN 'MODIFIED' THEN 'Before: ' || method_name || chr(10) || 'After: ' || method_name ELSE '' END AS prompt FROM {method_f}""")
def c35(f: Facts) -> DataFrame:
    m = F.col("method_name")
    text = F.when(F.col("change_type") == "ADDED", F.concat(F.lit("New: "), m)).when(F.col("change_type") == "DELETED", F.concat(F.lit("Removed: "), m))
    return f.method_f.select("method_id", text.when(F.col("change_type") == "MODIFIED", F.concat(F.lit("Before: "), m, F.lit("\nAfter: "), m)).otherwise("").alias("prompt"))


ENTRY = """SELECT m.method_id, m.class_id, CASE WHEN annotation IN ('GetMapping', 'PostMapping') OR is_api THEN 'HTTP_API' WHEN annotation = 'Scheduled' THEN 'SCHEDULED_TASK' WHEN annotation = 'EventListener' THEN 'EVENT_LISTENER'
    WHEN annotation IN ('KafkaListener', 'RabbitListener') THEN 'MESSAGE_CONSUMER' WHEN lower(class_name) LIKE '%controller' THEN 'CONTROLLER_BY_CONVENTION' END AS entry_type
  FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id"""


@query("E01_entry_methods", f"SELECT method_id, entry_type FROM ({ENTRY}) x WHERE entry_type IS NOT NULL")
def e01(f: Facts) -> DataFrame:
    return entries.entry_methods(f.method_f, f.class_f).select("method_id", "entry_type")


@query("E02_root_types", f"""SELECT x.method_id, CASE WHEN entry_type IS NOT NULL THEN entry_type WHEN e.callee_id IS NULL THEN 'NO_STATIC_CALLER' ELSE 'INTERMEDIATE' END AS root_type
  FROM ({ENTRY}) x LEFT JOIN (SELECT DISTINCT callee_id FROM {{edge_f}}) e ON x.method_id = e.callee_id""")
def e02(f: Facts) -> DataFrame:
    return entries.root_types(f.method_f, f.class_f, f.edge_f).select("method_id", "root_type")


@query("E03_annotation_types", """SELECT entry_type, count(*) AS n FROM (SELECT CASE WHEN annotation IN ('GetMapping', 'PostMapping') THEN 'HTTP_API' WHEN annotation = 'Scheduled' THEN 'SCHEDULED_TASK'
  WHEN annotation = 'EventListener' THEN 'EVENT_LISTENER' WHEN annotation IN ('KafkaListener', 'RabbitListener') THEN 'MESSAGE_CONSUMER' END AS entry_type FROM {method_f}) x WHERE entry_type IS NOT NULL GROUP BY entry_type""")
def e03(f: Facts) -> DataFrame:
    return f.method_f.select(entries.annotation_entry(F.col("annotation")).alias("entry_type")).filter("entry_type is not null").groupBy("entry_type").agg(F.count("*").alias("n"))


@query("E04_controllers", "SELECT class_id, CASE WHEN is_controller THEN controller_base_url END AS base_url, is_controller FROM {class_f}")
def e04(f: Facts) -> DataFrame:
    names = F.from_json("annotations", "array<struct<name:string>>")
    found = F.exists(names, lambda a: a["name"].isin("RestController", "Controller"))
    return f.class_f.select("class_id", F.when(found, F.col("controller_base_url")).alias("base_url"), found.alias("is_controller"))


@query("E05_api_methods", "SELECT m.method_id, m.is_api AND c.is_controller AS is_api FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id")
def e05(f: Facts) -> DataFrame:
    return f.method_f.join(f.class_f.select("class_id", "is_controller"), "class_id").select("method_id", (F.col("is_api") & F.col("is_controller")).alias("is_api"))


@query("E06_inherited_api", """SELECT m.method_id, coalesce(i.api, m.is_api) AS is_api FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id
  LEFT JOIN (SELECT class_id, method_name, parameters, bool_or(is_api) AS api FROM {method_f} GROUP BY class_id, method_name, parameters) i
  ON c.implements_id = i.class_id AND m.method_name = i.method_name AND m.parameters = i.parameters AND m.annotation = 'Override'""")
def e06(f: Facts) -> DataFrame:
    return entries.inherited_api(f.method_f, f.class_f).select("method_id", "is_api")


@query("E07_recommendations", """SELECT change_type, CASE WHEN 100.0 * count(e.callee_id) / count(*) < 30 THEN 'LOW_COVERAGE' ELSE 'COMPLETE' END AS advice
  FROM {method_f} m LEFT JOIN (SELECT DISTINCT callee_id FROM {edge_f}) e ON m.method_id = e.callee_id GROUP BY change_type""")
def e07(f: Facts) -> DataFrame:
    callers = f.edge_f.select("callee_id").distinct()
    rows = f.method_f.join(callers, F.col("method_id") == F.col("callee_id"), "left").groupBy("change_type").agg((100.0 * F.count("callee_id") / F.count("*")).alias("coverage"))
    return rows.select("change_type", F.array_join(entries.recommendations(F.col("coverage")), ",").alias("advice"))
