"""Queries on SQL statements: tables, risk, rules and field lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions import sqltext as S
from ..operators import lineage
from ..registry import query



def text() -> Column:
    return F.col("sql_content")


def kind() -> Column:
    return F.col("sql_type")


NOT = ", ".join(f"'{w}'" for w in S.NOT_TABLES)
FOUND = " || ".join("regexp_extract_all(sql_content, '" + p.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', 1)" for p in S.TABLE_PATTERNS)
WITH_TABLES = f"SELECT *, list_sort(list_distinct(list_filter({FOUND}, lambda t: upper(t) NOT IN ({NOT})))) AS tables FROM {{stmt_f}}"
WHERE = "upper(sql_content) LIKE '%WHERE%'"
LIMIT = "(upper(sql_content) LIKE '%LIMIT%' OR upper(sql_content) LIKE '%ROWNUM%' OR upper(sql_content) LIKE '%FETCH FIRST%')"
RULES = """SELECT stmt_id, class_id, method_id, sql_type, sql_content,
  sql_type = 'SELECT' AND upper(sql_content) NOT LIKE '%WHERE%' AND upper(sql_content) NOT LIKE '%LIMIT%' AS r1, regexp_matches(sql_content, '(?i)SELECT\\s+\\*') AS r2, regexp_matches(sql_content, '(?i)LIKE\\s+''%') AS r3,
  len(string_split(upper(sql_content), 'SELECT')) - 1 > 1 AS r4, len(string_split(upper(sql_content), ' OR ')) - 1 >= 3 AS r5 FROM {stmt_f}"""
SCORED = f"SELECT *, greatest(0, 100 - 20 * r1::INT - 10 * r2::INT - 20 * r3::INT - 10 * r4::INT - 5 * r5::INT) AS score FROM ({RULES}) r"
LEVEL = "CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' ELSE 'POOR' END"
FIELDS = """SELECT stmt_id, method_id, class_id, sql_type, unnest(CASE sql_type
    WHEN 'SELECT' THEN list_transform(list_filter(string_split(trim(regexp_extract(sql_content, '(?is)SELECT\\s+(.*?)\\s+FROM', 1)), ','), lambda c: trim(c) <> '' AND trim(c) <> '*' AND strpos(c, '(') = 0), lambda c: regexp_extract(trim(c), '^(?:\\w+\\.)?(\\w+)', 1))
    WHEN 'INSERT' THEN list_transform(string_split(regexp_extract(sql_content, '(?i)INSERT\\s+INTO\\s+\\w+\\s*\\((.*?)\\)', 1), ','), lambda c: trim(replace(c, '`', '')))
    WHEN 'UPDATE' THEN list_transform(list_filter(string_split(regexp_extract(sql_content || ' WHERE ', '(?is)UPDATE\\s+\\w+\\s+SET\\s+(.*?)\\s+WHERE', 1), ','), lambda a: strpos(a, '=') > 0), lambda a: trim(string_split(a, '=')[1]))
    ELSE [] END) AS field FROM {stmt_f}"""
LINEAGE = f"""SELECT l.stmt_id, t.tables[1] AS table_name, l.field, CASE WHEN l.sql_type = 'SELECT' THEN 'READ' ELSE 'WRITE' END AS op, lower(c.class_name) || '.' || l.method_id AS mapper_method
  FROM ({FIELDS}) l JOIN ({WITH_TABLES}) t ON l.stmt_id = t.stmt_id JOIN {{class_f}} c ON l.class_id = c.class_id"""


@query("C13_sql_tables", f"SELECT stmt_id, array_to_string(tables, ',') AS tables FROM ({WITH_TABLES}) x")
def c13(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", F.array_join(S.tables(text()), ",").alias("tables"))


@query("C15_statement_attribute", "SELECT stmt_id, method_id AS id FROM {stmt_f}")
def c15(f: Facts) -> DataFrame:
    line = F.concat(F.lit('<select id="'), "method_id", F.lit('" resultType="x">'))
    return f.stmt_f.select("stmt_id", F.regexp_extract(line, '\\bid\\s*=\\s*"([^"]*)"', 1).alias("id"))


# lines of mappers: other attributes before, other quotes, spaces, values that are no words, none at all
ATTRIBUTE_LINES = """SELECT stmt_id, CASE stmt_id % 5 WHEN 0 THEN '<' || lower(sql_type) || ' id="' || method_id || '" resultMap = "rm' || CAST(class_id AS STRING) || '">' WHEN 1 THEN '<select resultMap=' || chr(39) || 'a.b' || chr(39) || ' parentid="p1" id =  ' || chr(39) || method_id || chr(39) || '>'
  WHEN 2 THEN '  <include refid="' || method_id || '"/> WHERE id = #' || chr(123) || 'id' || chr(125) WHEN 3 THEN '<sql id="a-b" resultMap="" id="' || method_id || '">' ELSE sql_content END AS line FROM {stmt_f}"""


@query("C15_line_attributes", f"SELECT stmt_id, nullif(regexp_extract(line, 'id\\s*=\\s*[''\"](\\w+)[''\"]', 1), '') AS id, nullif(regexp_extract(line, 'resultMap\\s*=\\s*[''\"](\\w+)[''\"]', 1), '') AS result_map FROM ({ATTRIBUTE_LINES}) x")
def c15_lines(f: Facts) -> DataFrame:
    """Attributes of whole mapper lines."""
    rows = f.spark.sql(ATTRIBUTE_LINES, stmt_f=f.stmt_f)
    return rows.select("stmt_id", S.attribute(F.col("line"), "id").alias("id"), S.attribute(F.col("line"), "resultMap").alias("result_map"))


@query("C16_where_limit", f"SELECT stmt_id, sql_type = 'INSERT' OR {WHERE} AS has_where, {LIMIT} AS has_limit FROM {{stmt_f}}")
def c16(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", S.has_where(text(), kind()).alias("has_where"), S.has_limit(text()).alias("has_limit"))


@query("C17_estimated_rows", f"""SELECT stmt_id, CASE WHEN sql_type IN ('DELETE', 'UPDATE') AND NOT {WHERE} THEN 'ALL' WHEN {LIMIT} THEN CASE WHEN try_cast(regexp_extract(upper(sql_content), 'LIMIT\\s+(\\d+)', 1) AS BIGINT) = 1 THEN 'ONE'
  WHEN coalesce(try_cast(regexp_extract(upper(sql_content), 'LIMIT\\s+(\\d+)', 1) AS BIGINT), 0) <= 10 THEN 'FEW' ELSE 'MANY' END
  WHEN sql_type = 'SELECT' AND {WHERE} THEN CASE WHEN regexp_matches(sql_content, 'WHERE\\s+\\w+\\s*=\\s*#\\{{{{') THEN 'ONE' ELSE 'MANY' END WHEN sql_type = 'INSERT' THEN 'ONE' ELSE 'UNKNOWN' END AS estimate FROM {{stmt_f}}""".replace("\\{{{{", "\\{{"))
def c17(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", S.estimated_rows(text(), kind()).alias("estimate"))


@query("C18_risk", f"""SELECT stmt_id, CASE WHEN sql_type IN ('DELETE', 'UPDATE') AND NOT {WHERE} THEN 'CRITICAL' WHEN sql_type = 'DELETE' THEN 'HIGH' WHEN sql_type = 'UPDATE' THEN 'MEDIUM'
  WHEN sql_type = 'SELECT' AND NOT {WHERE} AND upper(sql_content) NOT LIKE '%LIMIT%' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  concat_ws(';', CASE WHEN sql_type = 'DELETE' THEN 'DELETE_AFFECTS' END, CASE WHEN sql_type = 'DELETE' AND NOT {WHERE} THEN 'DELETE_WITHOUT_WHERE' END, CASE WHEN sql_type = 'UPDATE' AND NOT {WHERE} THEN 'UPDATE_WITHOUT_WHERE' END,
    CASE WHEN sql_type = 'UPDATE' AND {WHERE} THEN 'UPDATE_AFFECTS' END, CASE WHEN sql_type = 'INSERT' THEN 'INSERT_AFFECTS' END, CASE WHEN sql_type = 'SELECT' AND NOT {WHERE} AND upper(sql_content) NOT LIKE '%LIMIT%' THEN 'SELECT_UNBOUNDED' END,
    CASE WHEN is_dynamic_sql THEN 'DYNAMIC_SQL' END) AS warnings FROM {{stmt_f}}""")
def c18(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", S.risk_level(text(), kind()).alias("risk"), F.array_join(S.warning_codes(text(), kind(), F.col("is_dynamic_sql")), ";").alias("warnings"))


@query("C19_is_dao", """SELECT m.method_id, regexp_matches(c.class_name, '(Mapper|Dao|Repository)$') OR contains(c.package_name || '.' || c.class_name, '.mapper.') OR contains(c.package_name || '.' || c.class_name, '.dao.') OR s.linked_method_id IS NOT NULL AS is_dao
  FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id LEFT JOIN (SELECT DISTINCT linked_method_id FROM {stmt_f}) s ON s.linked_method_id = m.method_id""")
def c19(f: Facts) -> DataFrame:
    return lineage.dao_methods(f.method_f, f.class_f, f.stmt_f)


for _id, _name, _severity, _flag in (("R01", "FULL_TABLE_SCAN", "HIGH", "r1"), ("R02", "SELECT_STAR", "MEDIUM", "r2"), ("R03", "LIKE_WILDCARD", "HIGH", "r3"), ("R04", "NESTED_SUBQUERY", "MEDIUM", "r4"), ("R05", "OR_CONDITION", "LOW", "r5")):

    @query(f"{_id}_{_name.lower()}", f"SELECT stmt_id, '{_name}' AS issue, '{_severity}' AS severity FROM ({RULES}) x WHERE {_flag}")
    def rule(f: Facts, name: str = _name) -> DataFrame:
        own = [r for r in S.RULES if r.name == name]
        return f.stmt_f.select("stmt_id", F.explode(S.issues(text(), kind(), own)).alias("i")).select("stmt_id", F.col("i.name").alias("issue"), "i.severity")


@query("C20_all_issues", f"SELECT stmt_id, CAST(r1::INT + r2::INT + r3::INT + r4::INT + r5::INT AS INT) AS n_issues FROM ({RULES}) x")
def c20(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", F.size(S.issues(text(), kind())).alias("n_issues"))


@query("R06_score_level", f"SELECT stmt_id, score, {LEVEL} AS level FROM ({SCORED}) x")
@query("A13_performance_score", f"SELECT stmt_id, score, {LEVEL} AS level FROM ({SCORED}) x")
def r06(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", S.score(S.issues(text(), kind())).alias("score")).withColumn("level", S.level(F.col("score")))


@query("C21_statement_fields", f"SELECT stmt_id, field FROM ({FIELDS}) x")
def c21(f: Facts) -> DataFrame:
    return f.stmt_f.select("stmt_id", F.explode(S.fields(text(), kind())).alias("field"))


@query("C22_field_kinds", "SELECT class_id, CASE WHEN lower(class_name) LIKE '%controller%' THEN 'USER_INPUT' WHEN lower(class_name) LIKE '%config%' THEN 'CONFIG' ELSE 'OTHER_TABLE' END AS source_kind, CASE WHEN lower(class_name) LIKE '%controller%' THEN 'API' WHEN lower(class_name) LIKE '%service%' THEN 'SERVICE' ELSE 'OTHER_SQL' END AS consumer_kind FROM {class_f}")
def c22(f: Facts) -> DataFrame:
    return f.class_f.select("class_id", S.source_kind(F.col("class_name")).alias("source_kind"), S.consumer_kind(F.col("class_name")).alias("consumer_kind"))


@query("P09_field_lineage", LINEAGE)
def p09(f: Facts) -> DataFrame:
    return lineage.field_edges(f.stmt_f, f.class_f)


@query("A14_field_reads_writes", f"SELECT table_name, field, count(*) FILTER (op = 'READ') AS reads, count(*) FILTER (op = 'WRITE') AS writes FROM ({LINEAGE}) x GROUP BY table_name, field")
def a14(f: Facts) -> DataFrame:
    return lineage.reads_writes(lineage.field_edges(f.stmt_f, f.class_f))


KINDS = "CASE WHEN mapper_method LIKE '%controller%' THEN 'API' WHEN mapper_method LIKE '%service%' THEN 'SERVICE' ELSE 'OTHER_SQL' END"


@query("A15_field_impact", f"""SELECT table_name, field, count(*) FILTER ({KINDS} = 'API') AS api, count(*) FILTER ({KINDS} = 'SERVICE') AS service, count(*) FILTER ({KINDS} = 'OTHER_SQL') AS other, count(*) AS total,
  CASE WHEN count(*) > 10 THEN 'HIGH' WHEN count(*) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ({LINEAGE}) x WHERE op = 'READ' GROUP BY table_name, field""")
def a15(f: Facts) -> DataFrame:
    return lineage.impact(lineage.field_edges(f.stmt_f, f.class_f))


@query("A16_lineage_statistics", f"""SELECT count(*) AS fields, count(*) FILTER (writes > 0) AS with_sources, count(*) FILTER (reads > 0) AS with_consumers, round(100.0 * count(*) FILTER (writes > 0) / count(*), 2) AS percent_with_sources
  FROM (SELECT table_name, field, count(*) FILTER (op = 'READ') AS reads, count(*) FILTER (op = 'WRITE') AS writes FROM ({LINEAGE}) x GROUP BY table_name, field) y""")
def a16(f: Facts) -> DataFrame:
    return lineage.statistics(lineage.reads_writes(lineage.field_edges(f.stmt_f, f.class_f)))


@query("P01_dao_analysis", f"""SELECT s.stmt_id, CASE WHEN sql_type IN ('DELETE', 'UPDATE') AND NOT {WHERE} THEN 'CRITICAL' WHEN sql_type = 'DELETE' THEN 'HIGH' WHEN sql_type = 'UPDATE' THEN 'MEDIUM' WHEN sql_type = 'SELECT' AND NOT {WHERE} AND upper(sql_content) NOT LIKE '%LIMIT%' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  score, {LEVEL} AS level, coalesce(n, 0) AS n_fields FROM ({SCORED}) s LEFT JOIN (SELECT stmt_id, count(*) AS n FROM ({FIELDS}) l GROUP BY stmt_id) g ON s.stmt_id = g.stmt_id""")
def p01(f: Facts) -> DataFrame:
    points = S.score(S.issues(text(), kind()))
    return f.stmt_f.select("stmt_id", S.risk_level(text(), kind()).alias("risk"), points.alias("score"), S.level(points).alias("level"), F.size(S.fields(text(), kind())).cast("long").alias("n_fields"))


@query("A03_mapper_statistics", """SELECT count(*) AS total, count(*) FILTER (sql_type = 'SELECT') AS selects, count(*) FILTER (sql_type = 'INSERT') AS inserts, count(*) FILTER (sql_type = 'UPDATE') AS updates, count(*) FILTER (sql_type = 'DELETE') AS deletes,
  count(*) FILTER (mapper_type = 'XML') AS xml, count(*) FILTER (mapper_type = 'ANNOTATION') AS annotation, count(*) FILTER (is_dynamic_sql) AS dynamic FROM {stmt_f}""")
def a03(f: Facts) -> DataFrame:
    n = F.count_if
    return f.stmt_f.agg(
        F.count("*").alias("total"), *[n(kind() == k).alias(a) for k, a in (("SELECT", "selects"), ("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))],
        n(F.col("mapper_type") == "XML").alias("xml"), n(F.col("mapper_type") == "ANNOTATION").alias("annotation"), n(F.col("is_dynamic_sql")).alias("dynamic"),
    )


@query("A08_sql_summary", f"""SELECT 'type:' || sql_type AS item, count(*) AS n FROM {{stmt_f}} GROUP BY sql_type UNION ALL SELECT 'level:' || {LEVEL}, count(*) FROM ({SCORED}) x GROUP BY {LEVEL}
  UNION ALL SELECT 'tables', count(DISTINCT t) FROM (SELECT unnest(tables) AS t FROM ({WITH_TABLES}) y) z""")
def a08(f: Facts) -> DataFrame:
    x = f.stmt_f.select("sql_type", S.level(S.score(S.issues(text(), kind()))).alias("level"), S.tables(text()).alias("tables"))
    kinds = x.groupBy(F.concat(F.lit("type:"), "sql_type").alias("item")).agg(F.count("*").alias("n"))
    levels = x.groupBy(F.concat(F.lit("level:"), "level").alias("item")).agg(F.count("*").alias("n"))
    return kinds.union(levels).union(x.select(F.explode("tables").alias("t")).agg(F.lit("tables"), F.count_distinct("t")))


@query("F12_statement_filter", f"SELECT stmt_id, score FROM ({SCORED}) x WHERE sql_type IN ('SELECT', 'UPDATE') AND {LEVEL} IN ('GOOD', 'FAIR') AND score >= 60")
def f12(f: Facts) -> DataFrame:
    x = f.stmt_f.select("stmt_id", "sql_type", S.score(S.issues(text(), kind())).alias("score"))
    return x.filter(F.col("sql_type").isin("SELECT", "UPDATE") & S.level(F.col("score")).isin("GOOD", "FAIR") & (F.col("score") >= 60)).select("stmt_id", "score")
