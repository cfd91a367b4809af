"""Code facts as projections of the driver's tables.

Each fact is one SQL text in the common subset of Spark SQL and DuckDB, over whole tables:
`{name}` stands for a table or for another fact. Spark gets DataFrames for the names, the
oracle gets common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FACTS: dict[str, str] = {}

FACTS["class_f"] = """
SELECT s_suppkey AS class_id, 0 AS project_id,
  'C' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 4 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Mapper' ELSE 'Impl' END AS class_name,
  'com.' || lower(replace(n_name, ' ', '_')) || CASE WHEN s_suppkey % 20 = 3 THEN '.dao' WHEN s_suppkey % 20 = 5 THEN '.mapper' ELSE '' END AS package_name,
  CASE WHEN s_suppkey % 10 < 2 THEN 'Interface' ELSE 'Class' END AS class_type,
  CASE WHEN s_suppkey % 10 >= 5 THEN s_suppkey - 3 END AS extends_id,
  CASE WHEN s_suppkey % 10 >= 2 THEN s_suppkey - s_suppkey % 10 + s_suppkey % 2 WHEN s_suppkey % 10 = 1 THEN s_suppkey - 1 END AS implements_id,
  'src/main/java/c' || CAST(s_suppkey AS STRING) || '.java' AS filepath,
  CASE WHEN s_suppkey % 4 = 0 THEN '[{{"name":"RestController"}},{{"name":"RequestMapping"}}]' WHEN s_suppkey % 4 = 1 THEN '[{{"name":"Service"}},{{"name":"Data"}}]' ELSE '[]' END AS annotations,
  s_suppkey % 4 = 0 AS is_controller,
  '/c' || CAST(s_suppkey AS STRING) || '/' AS controller_base_url,
  CASE s_suppkey % 7 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'MODIFIED' WHEN 2 THEN 'DELETED' ELSE 'UNCHANGED' END AS change_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS commit_or_branch
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

FACTS["method_f"] = """
SELECT CAST(p_partkey AS BIGINT) AS method_id, CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS BIGINT) AS class_id, 0 AS project_id,
  CASE p_partkey % 7 WHEN 0 THEN 'getItem' WHEN 1 THEN 'setItem' WHEN 2 THEN 'listAll' WHEN 3 THEN 'forEachRow' WHEN 4 THEN 'saveBatch' WHEN 5 THEN 'updateOne' ELSE 'deleteOne' END || CAST(p_partkey % 3 AS STRING) AS method_name,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Long' WHEN 2 THEN 'String,Map<String,Integer>' WHEN 3 THEN 'int,List<String>' ELSE 'java.lang.Long' END AS parameters,
  CAST((p_partkey % 50) * 20 + 1 AS INT) AS start_line, CAST((p_partkey % 50) * 20 + 1 + p_size % 18 AS INT) AS end_line,
  p_partkey % 9 = 0 AS is_static, p_partkey % 13 = 0 AS is_abstract, p_partkey % 3 = 0 AS is_api,
  CASE p_partkey % 11 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'MODIFIED' WHEN 2 THEN 'DELETED' ELSE 'UNCHANGED' END AS change_type,
  CASE WHEN p_partkey % 5 = 0 THEN 'None' WHEN p_partkey % 5 = 1 THEN NULL ELSE p_name END AS documentation,
  CASE p_partkey % 12 WHEN 0 THEN 'Scheduled' WHEN 1 THEN 'EventListener' WHEN 2 THEN 'KafkaListener' WHEN 3 THEN 'GetMapping' WHEN 4 THEN 'PostMapping' WHEN 5 THEN 'Override' WHEN 6 THEN 'RabbitListener' ELSE '' END AS annotation,
  p_brand AS brand, p_retailprice AS price
FROM {part}
"""

# the increment: a second version of some methods, with other lines and new ids
FACTS["method_v"] = """
SELECT method_id, class_id, project_id, method_name, parameters, start_line, end_line, is_api, change_type FROM {method_f}
UNION ALL
SELECT method_id + (SELECT count(*) FROM {part}), class_id, 1, method_name,
  CASE WHEN method_id % 10 = 0 THEN parameters ELSE 'Object' END, start_line + 3, end_line + 3, is_api,
  CASE WHEN method_id % 10 = 0 THEN 'MODIFIED' ELSE 'ADDED' END
FROM {method_f} WHERE method_id % 5 = 0
"""

FACTS["call_f"] = """
SELECT CAST(l_partkey AS BIGINT) AS caller_id,
  CAST((l_partkey * 31 + (l_suppkey % 2) * 17 + 1) % (SELECT count(*) FROM {part}) AS BIGINT) AS callee_id, l_linenumber AS line
FROM {lineitem}
"""

FACTS["edge_f"] = """
SELECT caller_id, callee_id, CAST(min(line) AS INT) AS first_line, count(DISTINCT line) AS sites FROM {call_f} GROUP BY caller_id, callee_id
"""

FACTS["diff_f"] = """
SELECT CAST(l_suppkey AS BIGINT) AS class_id, l_orderkey AS hunk, l_linenumber AS pos, CAST(l_quantity * l_linenumber * 3 AS INT) AS line_no,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END AS op
FROM {lineitem}
"""

FACTS["stmt_f"] = """
SELECT CAST(p_partkey AS BIGINT) AS stmt_id, CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS BIGINT) AS class_id, 'stmt' || CAST(p_partkey % 40 AS STRING) AS method_id, p_size AS start_line,
  CASE p_partkey % 10 WHEN 6 THEN 'UPDATE' WHEN 7 THEN 'UPDATE' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'DELETE' WHEN 8 THEN 'INSERT' ELSE 'SELECT' END AS sql_type,
  CASE p_partkey % 10
    WHEN 0 THEN 'SELECT * FROM item_' || CAST(p_size AS STRING)
    WHEN 1 THEN 'SELECT id, name AS label, t.price FROM item_' || CAST(p_size AS STRING) || ' t WHERE id = #{{id}} LIMIT 1'
    WHEN 2 THEN 'select a from orders join users on a = b where name like ' || chr(39) || '%x' || chr(39) || ' limit 50'
    WHEN 3 THEN 'SELECT a FROM t1 WHERE b IN (SELECT b FROM t2) OR c = 1 OR d = 2 OR e = 3'
    WHEN 4 THEN 'DELETE FROM item_' || CAST(p_size AS STRING)
    WHEN 5 THEN 'DELETE FROM users WHERE id = #{{id}}'
    WHEN 6 THEN 'UPDATE item_' || CAST(p_size AS STRING) || ' SET name = #{{name}}, price = #{{price}}'
    WHEN 7 THEN 'UPDATE users SET age = 3 WHERE id IN (1, 2)'
    WHEN 8 THEN 'INSERT INTO orders (`id`, `user_id`, total) VALUES (1, 2, 3)'
    ELSE 'SELECT count(id) FROM orders WHERE user_id = 7' END AS sql_content,
  CASE p_partkey % 3 WHEN 0 THEN 'XML' WHEN 1 THEN 'ANNOTATION' ELSE 'PLUS' END AS mapper_type, p_partkey % 4 = 0 AS is_dynamic_sql,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey AS BIGINT) END AS linked_method_id
FROM {part}
"""

FACTS["import_f"] = """
SELECT c.class_id, t.package_name || '.' || t.class_name AS import_path, false AS is_wildcard FROM {class_f} c CROSS JOIN (SELECT count(*) AS n FROM {supplier}) z JOIN {class_f} t ON t.class_id = (c.class_id * 7 + 3) % z.n
UNION ALL
SELECT c.class_id, t.package_name, true FROM {class_f} c CROSS JOIN (SELECT count(*) AS n FROM {supplier}) z JOIN {class_f} t ON t.class_id = (c.class_id * 3 + 1) % z.n WHERE c.class_id % 4 = 1
"""

FACTS["field_f"] = """
SELECT CAST(p_partkey AS BIGINT) AS field_id, CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS BIGINT) AS class_id, 'field' || CAST(p_size AS STRING) AS field_name, coalesce(c.class_name, 'String') AS field_type
FROM {part} LEFT JOIN {class_f} c ON c.class_id = p_partkey % 97
"""

# which methods use which fields: by name, or by an accessor's name where via_accessor
FACTS["field_use_f"] = """
SELECT DISTINCT CAST(l_partkey AS BIGINT) AS method_id, CAST((l_partkey * 13 + (l_suppkey % 3) * 7 + 5) % (SELECT count(*) FROM {part}) AS BIGINT) AS field_id, l_suppkey % 2 = 0 AS via_accessor
FROM {lineitem}
"""

FACTS["cache_f"] = """
SELECT conv_id * 1000 + turn AS id, CASE turn % 2 WHEN 0 THEN 'single' ELSE 'chain' END AS analysis_type, role AS direction, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'v' || CAST(conv_id % 2 AS STRING) END AS baseline,
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'v9' END AS version, 'C' || CAST(conv_id % 4 AS STRING) AS class_name, 'm' || CAST(turn % 3 AS STRING) AS method_name, CASE conv_id % 2 WHEN 0 THEN 'ADDED' ELSE 'MODIFIED' END AS change_type,
  CAST(turn AS INT) AS created_at, text AS analysis_result
FROM {conversations}
"""

FACTS["task_f"] = """
SELECT CAST(o_orderkey AS BIGINT) AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
  'git@host:group/p' || CAST(o_custkey % 50 AS STRING) || '.git' AS git_url, 'u' || CAST(o_custkey % 17 AS STRING) AS user_name,
  'v' || CAST(o_orderkey % 4 AS STRING) AS tag_old, 'v' || CAST(o_orderkey % 6 AS STRING) AS tag_new,
  CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN NULL ELSE o_orderpriority END AS project_code,
  o_orderdate AS created_at, CAST(o_orderkey % 10 AS INT) AS max_depth, o_totalprice AS cost
FROM {orders}
"""

FACTS["llm_f"] = """
SELECT conv_id AS task_id, turn AS result_id, role AS kind, 'm' || CAST(conv_id % 5 AS STRING) AS method_name, CAST(turn AS INT) AS created_at, text AS analysis_result FROM {conversations}
"""

FACTS["log_f"] = """
SELECT event_id, ts, 'key' || CAST(user_id % 5 AS STRING) AS api_key, event_type <> 'error' AS success, value AS response_time FROM {events}
"""


class Facts:
    """Tables and facts of one folder by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in FACTS:
                needs = {n: getattr(self, n) for n in sorted(set(needed(FACTS[name])))}
                self._made[name] = self.spark.sql(FACTS[name], **needs)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def needed(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)


def oracle(sql: str) -> str:
    """sql, with {fact} names made common table expressions for DuckDB."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needed(text):
            if n in FACTS and n not in order:
                visit(FACTS[n])
                order.append(n)

    visit(sql)
    plain = lambda text: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")
    ctes = [f"{n} AS ({plain(FACTS[n]).strip()})" for n in order]
    body = plain(sql).strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {'RECURSIVE ' if m[1] else ''}{', '.join([*ctes, ''])}{body[m.end() :]}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
