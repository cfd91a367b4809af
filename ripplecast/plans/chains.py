"""Queries on call chains, hierarchies and the impact graph (G*, P*, A09-A11, A19, J20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import entries, graph, impact, lookup
from ..operators.hierarchy import implementing_methods
from ..operators.ranks import id_block, ranked
from ..registry import query
from ..session import written
from ..sources import documents
from .relational import BELOW, OVERRIDES

DEPTH = 5


def roots(f: Facts) -> DataFrame:
    return f.method_f.filter("change_type <> 'UNCHANGED'").select(F.col("method_id").alias("root_id"))


def reverse(f: Facts) -> DataFrame:
    return written(f.edge_f.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"), F.col("first_line").alias("line")))


def forward(f: Facts) -> DataFrame:
    return written(f.edge_f.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.col("first_line").alias("line")))


def up(f: Facts) -> DataFrame:
    return graph.chains(roots(f), reverse(f), DEPTH)


def down(f: Facts) -> DataFrame:
    return graph.chains(roots(f), forward(f), DEPTH)


def nodes_above(f: Facts, depth: int = DEPTH) -> DataFrame:
    """(root_id, node_id, depth): the distinct nodes of each root's reverse chains."""
    return graph.nearest(roots(f), reverse(f), depth)


def chain_sql(src: str, dst: str, name: str) -> str:
    return f"""WITH RECURSIVE {name} AS (
  SELECT method_id AS root_id, 0 AS depth, method_id AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS INT) AS line, CAST(method_id AS STRING) AS path, [method_id] AS seen, false AS is_cyclic FROM {{method_f}} WHERE change_type <> 'UNCHANGED'
  UNION ALL
  SELECT root_id, depth + 1, e.{dst}, node_id, e.first_line, path || '>' || CAST(e.{dst} AS STRING), list_append(seen, e.{dst}), list_contains(seen, e.{dst}) FROM {name} JOIN {{edge_f}} e ON e.{src} = {name}.node_id WHERE NOT is_cyclic AND depth < {DEPTH})
"""


UP, DOWN = chain_sql("callee_id", "caller_id", "up"), chain_sql("caller_id", "callee_id", "down")


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.select("root_id", "depth", "node_id", graph.path_text(F.col("path")).alias("path"), "is_cyclic")




@query("G01_forward_chains", DOWN + "SELECT root_id, depth, node_id, path, is_cyclic FROM down")
def g01(f: Facts) -> DataFrame:
    return nodes_of(down(f))


@query("G02_reverse_chains", UP + "SELECT root_id, depth, node_id, path, is_cyclic FROM up")
def g02(f: Facts) -> DataFrame:
    return nodes_of(up(f))


#: Calls, and steps from an interface's method to those that implement it; DOWN's walk over them.
CHA_DOWN = f"""WITH RECURSIVE b AS ({BELOW}), g AS (SELECT interface_method AS src, implementing_method AS dst FROM ({OVERRIDES}) o UNION SELECT caller_id, callee_id FROM {{edge_f}}),
  walk AS (SELECT method_id AS root_id, 0 AS depth, method_id AS node_id, [method_id] AS seen, false AS is_cyclic FROM {{method_f}} WHERE change_type <> 'UNCHANGED'
    UNION ALL SELECT root_id, depth + 1, g.dst, list_append(seen, g.dst), list_contains(seen, g.dst) FROM walk JOIN g ON g.src = walk.node_id WHERE NOT is_cyclic AND depth < {DEPTH})
"""


def down_with_implementations(f: Facts) -> DataFrame:
    """Chains of all changed methods along calls and interface-to-implementation steps."""
    steps = implementing_methods(f.method_f, f.class_f).union(f.edge_f.select("caller_id", "callee_id")).distinct()
    edges = written(steps.toDF("src", "dst").withColumn("line", F.lit(None).cast("int")))
    return graph.chains(roots(f), edges, DEPTH)


def linked_statements(f: Facts) -> DataFrame:
    return f.stmt_f.filter("linked_method_id IS NOT NULL").select(F.col("linked_method_id").alias("node_id"), "stmt_id", "sql_type", "sql_content")


@query("G03_chains_with_sql", CHA_DOWN + "SELECT w.root_id, w.depth, w.node_id, s.stmt_id FROM walk w JOIN {stmt_f} s ON s.linked_method_id = w.node_id")
def g03(f: Facts) -> DataFrame:
    """The statements met on every chain of a changed method, with interface calls resolved."""
    return down_with_implementations(f).join(linked_statements(f), "node_id").select("root_id", "depth", "node_id", "stmt_id")


@query("P02_sql_leaves", CHA_DOWN + "SELECT root_id, node_id AS dao_node, stmt_id, min(depth) + 1 AS depth, any_value(sql_type || ': ' || CASE WHEN length(sql_content) > 30 THEN left(sql_content, 30) || '...' ELSE sql_content END) AS label FROM walk JOIN {stmt_f} s ON s.linked_method_id = node_id GROUP BY root_id, node_id, stmt_id")
def p02(f: Facts) -> DataFrame:
    """A leaf below each data access node: its statement's kind and the start of its text."""
    label = F.concat(F.col("sql_type"), F.lit(": "), F.when(F.length("sql_content") > 30, F.concat(F.substring("sql_content", 1, 30), F.lit("..."))).otherwise(F.col("sql_content")))
    first = down_with_implementations(f).groupBy("root_id", "node_id").agg((F.min("depth") + 1).alias("depth"))
    return first.join(linked_statements(f), "node_id").select("root_id", F.col("node_id").alias("dao_node"), "stmt_id", "depth", label.alias("label"))


DOWN_DOC = "SELECT root_id, count(DISTINCT (node_id, seen)) AS nodes, max(depth) AS depth, count(DISTINCT CASE WHEN is_cyclic THEN (node_id, seen) END) AS cycles, count(DISTINCT CASE WHEN stmt_id IS NOT NULL THEN node_id END) AS dao_nodes, count(DISTINCT stmt_id) AS statements FROM walk LEFT JOIN {stmt_f} s ON s.linked_method_id = node_id GROUP BY root_id"


def down_documents(f: Facts) -> DataFrame:
    """Nodes, depth, cycles, data access methods and statements below each root."""
    each = down_with_implementations(f).groupBy("root_id", "node_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count_if("is_cyclic").alias("cycles"))
    leaves = linked_statements(f).groupBy("node_id").agg(F.count("*").alias("statements"))
    # statements are linked to one method each, so the numbers of distinct ones add up
    return each.join(leaves, "node_id", "left").groupBy("root_id").agg(F.sum("nodes").alias("nodes"), F.max("depth").alias("depth"), F.sum("cycles").alias("cycles"), F.count("statements").alias("dao_nodes"), F.coalesce(F.sum("statements"), F.lit(0)).alias("statements"))


@query("P04_downwards_document", CHA_DOWN + DOWN_DOC)
def p04(f: Facts) -> DataFrame:
    return down_documents(f)


def class_edges(f: Facts, column: str) -> DataFrame:
    return f.class_f.filter(f"{column} IS NOT NULL").select(F.col(column).alias("src"), F.col("class_id").alias("dst"))


def closure_sql(column: str) -> str:
    return f"""WITH RECURSIVE c AS (SELECT {column} AS src, class_id AS dst FROM {{class_f}} WHERE {column} IS NOT NULL UNION SELECT c.src, k.class_id FROM c JOIN {{class_f}} k ON k.{column} = c.dst) """


@query("G04_implementations", closure_sql("implements_id") + "SELECT src AS interface_id, dst AS class_id FROM c WHERE src <> dst")
def g04(f: Facts) -> DataFrame:
    return graph.closure(class_edges(f, "implements_id")).select(F.col("src").alias("interface_id"), F.col("dst").alias("class_id"))


@query("G05_subclasses", closure_sql("extends_id") + "SELECT src AS class_id, dst AS subclass_id FROM c WHERE src <> dst")
def g05(f: Facts) -> DataFrame:
    return graph.closure(class_edges(f, "extends_id")).select(F.col("src").alias("class_id"), F.col("dst").alias("subclass_id"))


SUPER = """WITH RECURSIVE s AS (SELECT class_id, class_id AS super_id, 0 AS distance FROM {class_f} UNION ALL SELECT s.class_id, k.extends_id, distance + 1 FROM s JOIN {class_f} k ON k.class_id = s.super_id WHERE k.extends_id IS NOT NULL) """


def supers(f: Facts) -> DataFrame:
    """(class_id, super_id, distance), itself at 0."""
    up_ = graph.closure(class_edges(f, "extends_id")).select(F.col("dst").alias("class_id"), F.col("src").alias("super_id"), "distance")
    return f.class_f.select("class_id", F.col("class_id").alias("super_id"), F.lit(0).alias("distance")).union(up_)


@query("G06_superclass_method", SUPER + "SELECT DISTINCT ON (class_id, method_name) s.class_id, m.method_name, m.method_id, s.distance FROM s JOIN {method_f} m ON m.class_id = s.super_id ORDER BY s.class_id, m.method_name, s.distance, m.method_id")
def g06(f: Facts) -> DataFrame:
    rows = supers(f).join(f.method_f.select(F.col("class_id").alias("super_id"), "method_name", "method_id"), "super_id")
    return lookup.first_per_key(rows, ["class_id", "method_name"], [F.asc("distance"), F.asc("method_id")]).select("class_id", "method_name", "method_id", "distance")


INHERITED = SUPER + "SELECT s.class_id, p.brand AS field, min(s.distance) AS distance FROM s JOIN {method_f} p ON p.class_id = s.super_id GROUP BY s.class_id, p.brand"


@query("G07_inherited_fields", INHERITED)
def g07(f: Facts) -> DataFrame:
    fields = f.method_f.select(F.col("class_id").alias("super_id"), F.col("brand").alias("field")).distinct()
    return supers(f).join(fields, "super_id").groupBy("class_id", "field").agg(F.min("distance").alias("distance"))


@query("X05_field_override", SUPER + "SELECT DISTINCT ON (class_id, field_name) s.class_id, x.field_name, x.field_id, x.field_type FROM s JOIN {field_f} x ON x.class_id = s.super_id ORDER BY s.class_id, x.field_name, s.distance, x.field_id")
def x05(f: Facts) -> DataFrame:
    """A class's own field hides the one of that name further up."""
    rows = supers(f).join(f.field_f.withColumnRenamed("class_id", "super_id"), "super_id")
    return lookup.first_per_key(rows, ["class_id", "field_name"], [F.asc("distance"), F.asc("field_id")]).select("class_id", "field_name", "field_id", "field_type")


IMPACT = """WITH RECURSIVE i AS (SELECT method_id AS node FROM {method_f} WHERE change_type = 'ADDED' UNION SELECT e.caller_id FROM i JOIN {edge_f} e ON e.callee_id = i.node) """


@query("G08_impact_fixpoint", IMPACT + "SELECT node FROM i")
def g08(f: Facts) -> DataFrame:
    """Everything that reaches an added method, to the fixpoint."""
    start = f.method_f.filter("change_type = 'ADDED'").select(F.col("method_id").alias("node"))
    return graph.reached(start, reverse(f)).select("node")


@query("P07_impact_of_objects", f"""WITH RECURSIVE b AS ({BELOW}), o AS ({OVERRIDES}), called AS (SELECT method_id, method_id AS target FROM {{method_f}} UNION ALL SELECT implementing_method, interface_method FROM o)
  SELECT 'xml' AS kind, stmt_id AS object_id, linked_method_id AS impacted FROM {{stmt_f}} WHERE linked_method_id IS NOT NULL
  UNION SELECT 'method', c.method_id, e.caller_id FROM called c JOIN {{method_f}} m ON m.method_id = c.method_id AND m.change_type <> 'UNCHANGED' JOIN {{edge_f}} e ON e.callee_id = c.target
  UNION SELECT 'class', k.class_id, e.caller_id FROM {{class_f}} k JOIN {{method_f}} m ON m.class_id = k.class_id AND k.change_type <> 'UNCHANGED' JOIN {{edge_f}} e ON e.callee_id = m.method_id
  UNION SELECT 'field', x.field_id, m.method_id FROM {{field_f}} x JOIN {{class_f}} k ON k.class_id = x.class_id AND contains(k.annotations, '"Data"') JOIN {{method_f}} m ON m.class_id = x.class_id""")
def p07(f: Facts) -> DataFrame:
    """One step of impact by the object's kind: a statement's method; callers of a method, through the interfaces
    that it implements too; callers of a class's methods; users of a field whose accessors are generated."""
    as_long = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("object_id").cast("long"), F.col("impacted").cast("long"))
    callers = f.edge_f.select(F.col("callee_id").alias("target"), F.col("caller_id").alias("impacted"))
    changed = f.method_f.filter("change_type <> 'UNCHANGED'").select("method_id")
    overrides = implementing_methods(f.method_f, f.class_f).select(F.col("implementing_method").alias("method_id"), F.col("interface_method").alias("target"))
    called = changed.withColumn("target", F.col("method_id")).union(overrides.join(changed, "method_id").select("method_id", "target"))
    statement = f.stmt_f.filter("linked_method_id IS NOT NULL").select(F.col("stmt_id").alias("object_id"), F.col("linked_method_id").alias("impacted"))
    method = called.join(callers, "target").select(F.col("method_id").alias("object_id"), "impacted")
    of_class = f.class_f.filter("change_type <> 'UNCHANGED'").join(f.method_f.select("class_id", F.col("method_id").alias("target")), "class_id").join(callers, "target").select(F.col("class_id").alias("object_id"), "impacted")
    with_data = f.class_f.filter(F.col("annotations").contains('"Data"')).select("class_id")
    # kinds differ, so each is made distinct on its own
    parts = [as_long(rows.distinct(), kind) for kind, rows in (("xml", statement), ("method", method), ("class", of_class))]
    return reduce(DataFrame.union, [*parts, as_long(impact.same_class(f.field_f, f.method_f, with_data), "field")])


STEPS = """up AS (SELECT class_id, extends_id AS above FROM {class_f} WHERE extends_id IS NOT NULL UNION SELECT class_id, implements_id FROM {class_f} WHERE implements_id IS NOT NULL),
  tops AS (SELECT class_id, above FROM up UNION SELECT t.class_id, u.above FROM tops t JOIN up u ON u.class_id = t.above),
  over AS (SELECT DISTINCT m.method_id, a.method_id AS above_id FROM {method_f} m JOIN tops t ON t.class_id = m.class_id JOIN {method_f} a ON a.class_id = t.above AND a.method_name = m.method_name AND a.parameters = m.parameters WHERE m.annotation = 'Override'),
  steps AS (SELECT 'statement' AS src_kind, stmt_id AS src, 'method' AS dst_kind, linked_method_id AS dst FROM {stmt_f} WHERE linked_method_id IS NOT NULL
    UNION SELECT 'class', CAST(m.class_id AS BIGINT), 'method', e.caller_id FROM {method_f} m JOIN {edge_f} e ON e.callee_id = m.method_id
    UNION SELECT 'class', CAST(k.class_id AS BIGINT), 'field', x.field_id FROM {class_f} k JOIN {field_f} x ON x.field_type = k.class_name
    UNION SELECT 'field', x.field_id, 'method', u.method_id FROM {field_f} x JOIN {class_f} k ON k.class_id = x.class_id JOIN {field_use_f} u ON u.field_id = x.field_id WHERE NOT u.via_accessor OR contains(k.annotations, '"Data"')
    UNION SELECT 'method', callee_id, 'method', caller_id FROM {edge_f}
    UNION SELECT 'method', o.method_id, 'method', e.caller_id FROM over o JOIN {edge_f} e ON e.callee_id = o.above_id)"""
CHANGED = """SELECT 'statement' AS kind, stmt_id AS id FROM {stmt_f} WHERE sql_type = 'DELETE' UNION ALL SELECT 'field', field_id FROM {field_f} WHERE field_type = 'String'
  UNION ALL SELECT 'class', CAST(class_id AS BIGINT) FROM {class_f} WHERE change_type = 'DELETED' UNION ALL SELECT 'method', method_id FROM {method_f} WHERE change_type = 'ADDED'"""


def impact_steps(f: Facts) -> DataFrame:
    return impact.relations(f.method_f, f.class_f, f.field_f, f.stmt_f, f.edge_f, f.field_use_f)


def changed_objects(f: Facts) -> DataFrame:
    """Deleting statements, fields of an unknown type, deleted classes and added methods."""
    parts = [("statement", f.stmt_f.filter("sql_type = 'DELETE'"), "stmt_id"), ("field", f.field_f.filter("field_type = 'String'"), "field_id"), ("class", f.class_f.filter("change_type = 'DELETED'"), "class_id"), ("method", f.method_f.filter("change_type = 'ADDED'"), "method_id")]
    return reduce(DataFrame.union, [rows.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id")) for kind, rows, key in parts])


@query("G08_typed_fixpoint", f"""WITH RECURSIVE {STEPS}, met AS (SELECT kind, id, 0 AS round FROM ({CHANGED}) c UNION SELECT s.dst_kind, s.dst, m.round + 1 FROM met m JOIN steps s ON s.src_kind = m.kind AND s.src = m.id WHERE m.round < 24)
  SELECT kind, id, min(round) AS round FROM met GROUP BY kind, id""")
def g08_typed(f: Facts) -> DataFrame:
    """What changed statements, fields, classes and methods reach, each with the round in which it was first met."""
    return impact.reached(changed_objects(f), impact_steps(f))


@query("P07_typed_impact", f"WITH RECURSIVE {STEPS} SELECT c.kind, c.id, s.dst_kind AS impacted_kind, s.dst AS impacted FROM ({CHANGED}) c JOIN steps s ON s.src_kind = c.kind AND s.src = c.id")
def p07_typed(f: Facts) -> DataFrame:
    """One step of impact of each changed object: fields by their uses, overriding methods also through all types above."""
    c = changed_objects(f)
    return c.join(impact_steps(f), (F.col("kind") == F.col("src_kind")) & (F.col("id") == F.col("src"))).select("kind", "id", F.col("dst_kind").alias("impacted_kind"), F.col("dst").alias("impacted"))


LEVELS = """WITH RECURSIVE e AS (SELECT extends_id AS src, class_id AS dst FROM {class_f} WHERE extends_id IS NOT NULL UNION SELECT implements_id, class_id FROM {class_f} WHERE implements_id IS NOT NULL),
  l AS (SELECT src AS node, 0 AS level FROM e UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node) """


def hierarchy(f: Facts) -> DataFrame:
    return class_edges(f, "extends_id").union(class_edges(f, "implements_id")).distinct()


@query("G09_longest_levels", LEVELS + "SELECT node, max(level) AS level FROM l GROUP BY node")
def g09(f: Facts) -> DataFrame:
    return graph.levels(hierarchy(f))


@query("P08_graph_layout", LEVELS + "SELECT node, level * 200 AS x, row_number() OVER (PARTITION BY level ORDER BY node) * 80 AS y FROM (SELECT node, max(level) AS level FROM l GROUP BY node) z")
def p08(f: Facts) -> DataFrame:
    rows = ranked(graph.levels(hierarchy(f)), ["level"], ["node"], id_block("node"))
    return rows.select("node", (F.col("level") * 200).alias("x"), (F.col("place") * 80).alias("y"))


@query("G10_preorder", UP + "SELECT root_id, path, row_number() OVER (PARTITION BY root_id ORDER BY seen) AS place FROM up")
def g10(f: Facts) -> DataFrame:
    """Pre-order by comparing paths from the root."""
    from pyspark.sql import Window

    rows = up(f)
    return rows.select("root_id", graph.path_text(F.col("path")).alias("path"), F.row_number().over(Window.partitionBy("root_id").orderBy("path")).alias("place"))


ENTRY = """SELECT m.method_id, CASE WHEN annotation IN ('GetMapping', 'PostMapping') OR is_api THEN 'HTTP_API' WHEN annotation = 'Scheduled' THEN 'SCHEDULED_TASK' WHEN annotation = 'EventListener' THEN 'EVENT_LISTENER'
    WHEN annotation IN ('KafkaListener', 'RabbitListener') THEN 'MESSAGE_CONSUMER' WHEN lower(class_name) LIKE '%controller' THEN 'CONTROLLER_BY_CONVENTION' END AS entry_type FROM {method_f} m JOIN {class_f} c ON m.class_id = c.class_id"""


def entry_types(f: Facts) -> DataFrame:
    return entries.entry_methods(f.method_f, f.class_f).select(F.col("method_id").alias("node_id"), "entry_type").filter("entry_type IS NOT NULL")


def entry_nodes(f: Facts) -> DataFrame:
    entry = entries.entry_methods(f.method_f, f.class_f).select(F.col("method_id").alias("node_id"), "entry_type")
    return up(f).join(entry, "node_id")


@query("G11_entry_points", UP + f"SELECT DISTINCT root_id, node_id, entry_type FROM up JOIN ({ENTRY}) e ON e.method_id = node_id WHERE entry_type IS NOT NULL")
@query("J20_chains_by_entry", UP + f"SELECT DISTINCT root_id, node_id, entry_type FROM up JOIN ({ENTRY}) e ON e.method_id = node_id WHERE entry_type IS NOT NULL")
def g11(f: Facts) -> DataFrame:
    return nodes_above(f).join(entry_types(f), "node_id").select("root_id", "node_id", "entry_type")


# a node met within a depth is met by a walk of that length
NEAR = """WITH RECURSIVE walk AS (SELECT method_id AS root_id, method_id AS node_id, 0 AS depth FROM {method_f} WHERE change_type <> 'UNCHANGED' UNION SELECT w.root_id, e.caller_id, w.depth + 1 FROM walk w JOIN {edge_f} e ON e.callee_id = w.node_id WHERE w.depth < 10),
  near AS (SELECT root_id, node_id, min(depth) AS depth FROM walk GROUP BY root_id, node_id) """


@query("G14_chain_methods_deep", NEAR + "SELECT root_id, node_id, depth FROM near")
def g14_deep(f: Facts) -> DataFrame:
    """The distinct methods of the chains of all changed methods, ten deep."""
    return graph.nearest_by_sets(roots(f), reverse(f), 10)


@query("G16_batch_nodes", NEAR + "SELECT c.class_name, m.method_name, min(depth) AS depth, count(DISTINCT root_id) AS chains, min(method_id) AS method_id FROM near JOIN {method_f} m ON m.method_id = node_id JOIN {class_f} c ON c.class_id = m.class_id GROUP BY c.class_name, m.method_name")
def g16_batch(f: Facts) -> DataFrame:
    """The methods of all chains by class and name, each once for a batch analysis, with the number of chains that need it."""
    start, edges = roots(f), reverse(f)
    names = written(f.method_f.join(f.class_f.select("class_id", "class_name"), "class_id").select(F.col("method_id").alias("node_id"), "class_name", "method_name"))
    # a group goes by its least method
    methods = written(graph.nearest_root(start, edges, 10).join(names, "node_id").groupBy("class_name", "method_name").agg(F.min("depth").alias("depth"), F.min("node_id").alias("method_id")))
    groups = names.join(methods.select("class_name", "method_name", F.col("method_id").alias("group_id")), ["class_name", "method_name"]).select("node_id", "group_id")
    counts = graph.root_counts(start, edges, 10, groups).select(F.col("group_id").alias("method_id"), F.col("roots").alias("chains"))
    return methods.join(counts, "method_id").select("class_name", "method_name", "depth", "chains", "method_id")


@query("J20_chains_of_entries", NEAR + f"SELECT node_id AS entry_id, entry_type, count(*) AS chains, min(depth) AS depth, arg_min(root_id, CAST(depth AS BIGINT) * 1000000000 + root_id) AS nearest_root FROM near JOIN ({ENTRY}) e ON e.method_id = node_id WHERE entry_type IS NOT NULL GROUP BY node_id, entry_type")
def j20_entries(f: Facts) -> DataFrame:
    """Each entry point with the chains that contain it: how many, and the nearest changed method."""
    start, edges = roots(f), reverse(f)
    entry = written(entry_types(f))
    near = graph.nearest_root(start, edges, 10).join(entry, "node_id")
    counts = graph.root_counts(start, edges, 10, entry.select("node_id", F.col("node_id").alias("group_id"))).select(F.col("group_id").alias("node_id"), F.col("roots").alias("chains"))
    return near.join(counts, "node_id").select(F.col("node_id").alias("entry_id"), "entry_type", "chains", "depth", F.col("root_id").alias("nearest_root"))


UP_DOC = f"""SELECT root_id, count(*) AS nodes, count(DISTINCT CASE WHEN entry_type IS NOT NULL THEN node_id END) AS entry_points, max(depth) AS depth, count(*) FILTER (is_cyclic) AS cycles,
  count(*) FILTER (depth = {DEPTH} AND NOT is_cyclic AND EXISTS (SELECT 1 FROM {{edge_f}} x WHERE x.callee_id = node_id)) AS cut FROM up JOIN ({ENTRY}) e ON e.method_id = node_id GROUP BY root_id"""


def up_documents(f: Facts) -> DataFrame:
    """Nodes, entry points, depth, cycles and paths cut at the depth limit above each root."""
    entry = entries.entry_methods(f.method_f, f.class_f).select(F.col("method_id").alias("node_id"), "entry_type")
    edges = reverse(f)
    more = edges.select(F.col("src").alias("node_id")).distinct().withColumn("more", F.lit(True))
    rows = graph.chains(roots(f), edges, DEPTH).join(entry, "node_id", "left").join(more, "node_id", "left")
    cut_off = (F.col("depth") == DEPTH) & ~F.col("is_cyclic") & F.coalesce("more", F.lit(False))
    return rows.groupBy("root_id").agg(
        F.count("*").alias("nodes"), F.count_distinct(F.when(F.col("entry_type").isNotNull(), F.col("node_id"))).alias("entry_points"), F.max("depth").alias("depth"),
        F.count_if("is_cyclic").alias("cycles"), F.count_if(cut_off).alias("cut"),
    )


# What a chain's limits and findings are called.
NOTES = "concat_ws(';', CASE WHEN depth = 0 THEN 'NO_CALLER' END, CASE WHEN entry_points = 0 THEN 'NO_ENTRY_POINT' END, CASE WHEN cycles > 0 THEN 'CYCLE_DETECTED' END, CASE WHEN cut > 0 THEN 'DEPTH_LIMITED' END)"


@query("P03_upwards_document", UP + f"SELECT *, {NOTES} AS notes FROM ({UP_DOC}) d")
def p03(f: Facts) -> DataFrame:
    return up_documents(f).withColumn("notes", F.expr(NOTES))


@query("P05_bidirectional", CHA_DOWN + UP.replace("WITH RECURSIVE", ",") + f"SELECT coalesce(u.root_id, d.root_id) AS root_id, u.nodes AS up_nodes, u.entry_points, u.depth AS up_depth, d.nodes AS down_nodes, d.depth AS down_depth, d.dao_nodes, d.statements FROM ({UP_DOC}) u FULL JOIN ({DOWN_DOC}) d ON u.root_id = d.root_id")
def p05(f: Facts) -> DataFrame:
    """Both directions of each changed method side by side; unchanged ones are no roots."""
    above = up_documents(f).select("root_id", F.col("nodes").alias("up_nodes"), "entry_points", F.col("depth").alias("up_depth"))
    below = down_documents(f).select("root_id", F.col("nodes").alias("down_nodes"), F.col("depth").alias("down_depth"), "dao_nodes", "statements")
    return above.join(below, "root_id", "full")


@query("G12_end_points", DOWN + "SELECT DISTINCT root_id, node_id FROM down d WHERE NOT EXISTS (SELECT 1 FROM {edge_f} e WHERE e.caller_id = d.node_id) OR is_cyclic OR depth = 5")
def g12(f: Facts) -> DataFrame:
    edges = forward(f)
    rows = graph.chains(roots(f), edges, DEPTH)
    inner = edges.select(F.col("src").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    return rows.join(inner, "node_id", "left").filter("inner IS NULL OR is_cyclic OR depth = 5").select("root_id", "node_id").distinct()


@query("G13_node_documentation", DOWN + "SELECT DISTINCT ON (root_id) root_id, m.documentation FROM down JOIN {method_f} m ON m.method_id = node_id WHERE m.documentation IS NOT NULL AND m.documentation <> 'None' ORDER BY root_id, seen")
def g13(f: Facts) -> DataFrame:
    docs = f.method_f.filter("documentation IS NOT NULL AND documentation <> 'None'").select(F.col("method_id").alias("node_id"), "documentation")
    return down(f).join(docs, "node_id").groupBy("root_id").agg(F.min_by("documentation", "path").alias("documentation"))


@query("G14_chain_methods", UP + "SELECT root_id, node_id, min(depth) AS depth FROM up GROUP BY root_id, node_id")
@query("G16_tree_nodes", UP + "SELECT root_id, node_id, min(depth) AS depth FROM up GROUP BY root_id, node_id")
def g14(f: Facts) -> DataFrame:
    return nodes_above(f)


@query("V16_chain_methods", UP + f"""SELECT d.root_id, d.node_id, d.depth, e.entry_type IS NOT NULL AS is_end, l.task_id AS latest_task, (row_number() OVER (PARTITION BY d.root_id ORDER BY d.depth, d.node_id) - 1) // 20 AS page
  FROM (SELECT root_id, node_id, min(depth) AS depth FROM up GROUP BY root_id, node_id) d JOIN ({ENTRY}) e ON e.method_id = d.node_id
  LEFT JOIN (SELECT method_name, arg_max(task_id, CAST(created_at AS BIGINT) * 1000000000 + task_id) AS task_id FROM {{llm_f}} GROUP BY method_name) l ON l.method_name = 'm' || CAST(d.node_id % 7 AS STRING)""")
def v16(f: Facts) -> DataFrame:
    """The distinct methods of each chain, with end points, the latest analysis of each, and its page of 20."""
    from pyspark.sql import Window

    entry = entries.entry_methods(f.method_f, f.class_f).select(F.col("method_id").alias("node_id"), F.lit(True).alias("is_end"))
    latest = f.llm_f.groupBy("method_name").agg(F.max_by("task_id", F.struct("created_at", "task_id")).alias("latest_task"))
    rows = nodes_above(f).withColumn("method_name", F.concat(F.lit("m"), (F.col("node_id") % 7).cast("string")))
    rows = rows.join(entry, "node_id", "left").join(latest, "method_name", "left")
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("depth", "node_id"))
    return rows.select("root_id", "node_id", "depth", F.coalesce("is_end", F.lit(False)).alias("is_end"), "latest_task", F.floor((place - 1) / 20).alias("page"))


CHAIN_DOC = "SELECT root_id, count(*) AS nodes, string_agg(path, ';' ORDER BY seen) AS chain FROM {name} GROUP BY root_id"


def chain_documents(rows: DataFrame) -> DataFrame:
    """A root's chain as one text: its paths in pre-order."""
    paths = F.transform(F.array_sort(F.collect_list("path")), graph.path_text)
    return rows.groupBy("root_id").agg(F.count("*").alias("nodes"), F.array_join(paths, ";").alias("chain"))


@query("V09_chain_documents", UP + ", " + DOWN.replace("WITH RECURSIVE", "") + f"SELECT 'upwards' AS direction, u.* FROM ({CHAIN_DOC.format(name='up')}) u UNION ALL SELECT 'downwards', d.* FROM ({CHAIN_DOC.format(name='down')}) d")
def v09(f: Facts) -> DataFrame:
    return chain_documents(up(f)).select(F.lit("upwards").alias("direction"), "*").union(chain_documents(down(f)).select(F.lit("downwards"), "*"))


@query("V10_report_text", UP + "SELECT root_id, string_agg(repeat(chr(9), depth) || m.method_name || ' (' || m.change_type || ')', chr(10) ORDER BY seen) AS report FROM up JOIN {method_f} m ON m.method_id = node_id GROUP BY root_id")
def v10(f: Facts) -> DataFrame:
    """The upwards report of each changed method: a line a node, indented by depth, in pre-order."""
    names = f.method_f.select(F.col("method_id").alias("node_id"), F.col("method_name").alias("name"), "change_type")
    return documents.report(up(f).join(names, "node_id"))


@query("V17_one_chain", UP + "SELECT depth, node_id, parent_id, line, path, is_cyclic FROM up WHERE root_id = (SELECT min(method_id) FROM {method_f} WHERE change_type = 'MODIFIED')")
def v17(f: Facts) -> DataFrame:
    """The chain of one method: the filter is the feature, and only that root is walked."""
    one = f.method_f.filter("change_type = 'MODIFIED'").agg(F.min("method_id").alias("root_id"))
    return graph.chains(one, reverse(f), DEPTH).select("depth", "node_id", "parent_id", "line", graph.path_text(F.col("path")).alias("path"), "is_cyclic")


NPLUS1 = """SELECT p.method_id AS parent_id, count(*) AS children FROM {edge_f} e JOIN {method_f} p ON p.method_id = e.caller_id JOIN (SELECT DISTINCT linked_method_id FROM {stmt_f}) s ON s.linked_method_id = e.callee_id
  WHERE regexp_matches(p.method_name, '(?i)foreach|for|loop|iterate|batch') GROUP BY p.method_id"""


@query("G15_n_plus_one", NPLUS1)
@query("R07_n_plus_one", NPLUS1)
def g15(f: Facts) -> DataFrame:
    loops = f.method_f.filter(F.col("method_name").rlike("(?i)foreach|for|loop|iterate|batch")).select(F.col("method_id").alias("caller_id"))
    mapped = f.stmt_f.filter("linked_method_id IS NOT NULL").select(F.col("linked_method_id").alias("callee_id")).distinct()
    return f.edge_f.join(loops, "caller_id").join(mapped, "callee_id", "left_semi").groupBy(F.col("caller_id").alias("parent_id")).agg(F.count("*").alias("children"))


@query("A09_node_counts", UP + "SELECT root_id, count(*) AS nodes FROM up GROUP BY root_id")
def a09(f: Facts) -> DataFrame:
    return up(f).groupBy("root_id").agg(F.count("*").alias("nodes"))


@query("A10_entry_counts", UP + f"SELECT root_id, count(*) AS entries FROM up JOIN ({ENTRY}) e ON e.method_id = node_id WHERE entry_type IS NOT NULL GROUP BY root_id")
def a10(f: Facts) -> DataFrame:
    return entry_nodes(f).groupBy("root_id").agg(F.count("*").alias("entries"))


@query("A11_coverage", UP + """SELECT count(DISTINCT root_id) AS methods, count(DISTINCT root_id) FILTER (depth = 1) AS with_callers, count(*) FILTER (is_cyclic) AS cyclic, count(*) FILTER (depth = 5 AND NOT is_cyclic AND node_id IN (SELECT callee_id FROM {edge_f})) AS depth_limited,
  round(100.0 * count(DISTINCT root_id) FILTER (depth = 1) / count(DISTINCT root_id), 2) AS coverage FROM up""")
def a11(f: Facts) -> DataFrame:
    edges = reverse(f)
    rows = graph.chains(roots(f), edges, DEPTH)
    more = edges.select(F.col("src").alias("node_id")).distinct().withColumn("more", F.lit(True))
    n, with_callers = F.count_distinct("root_id"), F.count_distinct(F.when(F.col("depth") == 1, F.col("root_id")))
    cut = (F.col("depth") == DEPTH) & ~F.col("is_cyclic") & F.coalesce("more", F.lit(False))
    return rows.join(more, "node_id", "left").agg(n.alias("methods"), with_callers.alias("with_callers"), F.count_if("is_cyclic").alias("cyclic"), F.count_if(cut).alias("depth_limited"), F.round(100.0 * with_callers / n, 2).alias("coverage"))


@query("A19_entries_by_type", UP + f"SELECT entry_type, count(DISTINCT node_id) AS n FROM up JOIN ({ENTRY}) e ON e.method_id = node_id WHERE entry_type IS NOT NULL GROUP BY entry_type")
def a19(f: Facts) -> DataFrame:
    return nodes_above(f).join(entry_types(f), "node_id").groupBy("entry_type").agg(F.count_distinct("node_id").alias("n"))


@query("P10_namespace_statements", "SELECT class_id, method_id, min(stmt_id) AS first_id, count(*) AS n FROM {stmt_f} GROUP BY class_id, method_id")
def p10(f: Facts) -> DataFrame:
    return f.stmt_f.groupBy("class_id", "method_id").agg(F.min("stmt_id").alias("first_id"), F.count("*").alias("n"))
