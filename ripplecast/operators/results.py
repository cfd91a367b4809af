"""Result documents of a run over call chains: nested trees, entry points, failures, limits and advice; texts and graphs from them.

A run is a table (kind, root_id, doc): a `metadata` row, a `chain` row a changed method, and a
`failed` row for each one whose class is not there. Rows of a run are JSON lines of one document,
so a run of any size is written and read by parts.

The nodes of a root's chains are moved once, to where its tree is put together: in order of the places of their
steps they are the tree in pre-order, so its text is their texts with brackets between them by depth. So a
root's tree is one value, and `top` gives a tree for each branch at that depth instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept, written
from . import entries

# What static analysis cannot see, and how much that matters.
LIMITATIONS = {"DYNAMIC_DISPATCH": "HIGH", "INTERFACE_RESOLUTION": "MEDIUM", "FRAMEWORK_CALLS": "MEDIUM", "NATIVE_CODE": "LOW"}


def to_json(doc: Column) -> Column:
    return F.to_json(doc, {"ignoreNullFields": "true"})


def with_member(doc: Column, name: str, value: Column) -> Column:
    """JSON object doc, which is not empty, with one more member whose value is JSON text; doc itself where that is null."""
    return F.coalesce(F.concat(F.left(doc, F.length(doc) - 1), F.lit(f',"{name}":'), value, F.lit("}")), doc)


def gathered(levels: list[DataFrame], fields: list[Column], top: int = 0, more: tuple[Column, ...] = ()) -> DataFrame:
    """(root_id, path, nodes) of the nodes at depth top: nodes are those of its tree in pre-order as (ranks, head, more), head the fields as JSON without its end.

    levels: tables as graph.chain_levels gives them, or with more columns, one a depth from 0.
    """
    columns = [c for c in levels[-1].columns if c != "parent_id"]
    rows = reduce(DataFrame.union, [level.select(*columns) for level in levels[top:]])
    head = to_json(F.struct(*fields))
    entry = F.struct("ranks", F.left(head, F.length(head) - 1).alias("head"), *more)
    # dealt before they are listed, so that each node is moved once and no lists are; whole roots have one short key, by which they stay for what follows
    path = F.slice("path", 1, top + 1).alias("path")
    keys = ["root_id", "path"] if top else ["root_id"]
    nodes = rows.select("root_id", path, entry.alias("entry")).select(*keys, "entry").repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list("entry")).alias("nodes"))
    return nodes if top else nodes.select("root_id", F.array(F.col("root_id").cast(rows.schema["node_id"].dataType)).alias("path"), "nodes")


def tree(nodes: str) -> Column:
    """The JSON tree of a column of gathered nodes: each with its fields, then its children, if any."""
    size = lambda i: F.size(F.get(F.col(nodes), i)["ranks"])

    def text(node: Column, i: Column) -> Column:
        depth, then = F.size(node["ranks"]), F.coalesce(size(i + 1), size(F.lit(0)))
        closed = F.concat(F.lit("}"), F.repeat(F.lit("]}"), depth - then), F.when(i + 1 < F.size(nodes), ",").otherwise(""))
        return F.concat(node["head"], F.when(then > depth, ',"children":[').otherwise(closed))

    return F.array_join(F.transform(F.col(nodes), text), "")


def nested(levels: list[DataFrame], fields: list[Column], top: int = 0) -> DataFrame:
    """(root_id, path, tree) of the nodes at depth top, tree as JSON: fields, then children in order of (line, node_id), if any."""
    return gathered(levels, fields, top).select("root_id", "path", tree("nodes").alias("tree"))


def labelled(levels: list[DataFrame], names: DataFrame) -> list[DataFrame]:
    """levels with the columns of names (node_id, ...), one row a node; nodes without a name stay."""
    return [level.join(names, "node_id", "left") for level in levels]


def named(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(node_id, name, change, entry): class and method, the change unless there is none, the entry type."""
    entry = entries.entry_methods(methods, classes).select("method_id", "entry_type")
    rows = methods.join(classes.select("class_id", "class_name"), "class_id", "left").join(entry, "method_id", "left")
    name = F.concat_ws(".", "class_name", "method_name")
    return rows.select(F.col("method_id").alias("node_id"), name.alias("name"), F.nullif("change_type", F.lit("UNCHANGED")).alias("change"), F.col("entry_type").alias("entry"))


def flag(condition: Column) -> Column:
    """True or null, so that compact JSON leaves false ones out."""
    return F.when(condition, True)


NODE = ["node_id", "name", "change", "line", "entry"]


def followed(names: DataFrame, edges: DataFrame) -> DataFrame:
    """names with goes_on, whether a step leads on from the node; nodes without a name that one leads on from are added."""
    more = edges.select(F.col("src").alias("node_id")).distinct().withColumn("goes_on", F.lit(True))
    return written(names.join(more, "node_id", "full"))


def trees(start: DataFrame, levels: list[DataFrame], names: DataFrame, fields: list[Column]) -> DataFrame:
    """start (root_id, method) with tree, nodes, depth, cyclic, cut and points of its chains; cut counts paths that end at the last level though a step goes on,
    points are the entry points met as (node_id, entry, depth), once each with the least depth.

    A root's rows meet in one place, where its tree and all its measures are taken from them.
    """
    # a root's first row brings its method along, so that no trees are joined
    none = F.lit(None).cast(start.schema["method"].dataType).alias("method")
    of = lambda level, method: level.select("root_id", "node_id", "path", "line", "depth", "is_cyclic", "ranks", method)
    one = reduce(DataFrame.union, [of(levels[0].join(start, "root_id"), F.col("method")), *[of(level, none) for level in levels[1:]]])
    more = (F.col("method"), F.col("node_id"), F.col("depth"), F.col("is_cyclic"), F.col("entry"), ((F.col("depth") == len(levels) - 1) & ~F.col("is_cyclic") & F.coalesce("goes_on", F.lit(False))).alias("cut"))
    rows = gathered(labelled([one], names), fields, more=more)
    count_of = lambda name: F.size(F.filter("nodes", lambda x: x[name])).cast("long").alias(name.removeprefix("is_"))
    found = F.sort_array(F.transform(F.filter("nodes", lambda x: x["entry"].isNotNull()), lambda x: F.struct(x["node_id"].alias("node_id"), x["entry"].alias("entry"), x["depth"].alias("depth"))))
    depth = F.array_max(F.transform("nodes", lambda x: x["depth"])).alias("depth")
    rows = rows.select("root_id", F.get("nodes", F.lit(0))["method"].alias("method"), tree("nodes").alias("tree"), F.size("nodes").cast("long").alias("nodes"), depth, count_of("is_cyclic"), count_of("cut"), found.alias("found"))
    first = F.filter("found", lambda x, i: (i == 0) | (F.get("found", i - 1)["node_id"] != x["node_id"]))
    return rows.withColumn("points", first).drop("found")


def limits() -> Column:
    """What a chain's measures say about its completeness."""
    found = [F.when(F.col("depth") == 0, "NO_CALLER"), F.when(F.size("entry_points") == 0, "NO_ENTRY_POINT"), F.when(F.col("cyclic") > 0, "CYCLE_DETECTED"), F.when(F.col("cut") > 0, "DEPTH_LIMITED")]
    return F.array_compact(F.array(*found))


def changed(methods: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed methods whose class the index holds, as (root_id, method), and the others as rows of a run."""
    there = classes.select("class_id", "class_name", (F.col("change_type") != "DELETED").alias("there"))
    info = F.struct(F.col("method_id").alias("id"), "class_name", "method_name", "parameters", F.col("change_type").alias("change"))
    rows = methods.filter("change_type <> 'UNCHANGED'").join(there, "class_id", "left").select(F.col("method_id").alias("root_id"), F.coalesce("there", F.lit(False)).alias("there"), info.alias("method"))
    failed = rows.filter("NOT there").select(F.lit("failed").alias("kind"), "root_id", to_json(F.struct("method", F.lit("CLASS_NOT_FOUND").alias("error"))).alias("doc"))
    return rows.filter("there").select("root_id", "method"), failed


def upwards(methods: DataFrame, classes: DataFrame, edges: DataFrame, levels_of, max_depth: int) -> DataFrame:
    """The run (kind, root_id, doc) towards callers. levels_of(roots): the levels of chains along edges (src, dst, line)."""
    start, failed = changed(methods, classes)
    levels = levels_of(start.select("root_id"))
    names = followed(named(methods, classes), edges)
    facts = trees(start, levels, names, [*[F.col(c) for c in NODE], flag(F.col("is_cyclic")).alias("cyclic")])
    facts = facts.withColumnRenamed("points", "entry_points").withColumn("limitations", limits())

    stats = F.struct("nodes", "depth", "cyclic", "cut").alias("stats")
    doc = F.struct(F.lit("upwards").alias("direction"), "method", "entry_points", stats, "limitations", (F.size("limitations") > 0).alias("has_incomplete_paths"))
    facts = facts.select("root_id", "depth", "cyclic", "cut", F.size("entry_points").alias("points"), with_member(to_json(doc), "chain", F.col("tree")).alias("doc"))
    facts = kept(facts, "chains")
    chains = facts.select(F.lit("chain").alias("kind"), "root_id", "doc")

    total = facts.agg(
        F.count("*").alias("total"), F.count_if(F.col("depth") > 0).alias("with_callers"), F.coalesce(F.sum("cyclic"), F.lit(0)).alias("cyclic"),
        F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"), F.coalesce(F.sum("points"), F.lit(0)).alias("entry_points"),
    ).withColumn("coverage", F.coalesce(F.round(F.try_divide(100.0 * F.col("with_callers"), F.col("total")), 2), F.lit(0.0)))
    advice = entries.recommendations(F.col("coverage"), F.col("cut"), F.col("entry_points"), F.col("with_callers"))
    return chains.union(failed).union(metadata("upwards", total, failed, max_depth, F.struct("with_callers", "cyclic", "cut", "entry_points", "coverage"), advice))


def metadata(direction: str, total: DataFrame, failed: DataFrame, max_depth: int, stats: Column, advice: Column | None = None) -> DataFrame:
    """The metadata row of a run, from one row of totals and the number of failures."""
    lost = failed.agg(F.count("*").alias("failed"))
    known = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("severity")) for k, v in LIMITATIONS.items()])
    more = [known.alias("analysis_limitations"), advice.alias("recommendations")] if advice is not None else []
    doc = F.struct(
        F.lit(direction).alias("direction"), (F.col("total") + F.col("failed")).alias("total_methods"), F.col("total").alias("successful_chains"), F.col("failed").alias("failed_chains"),
        F.lit(max_depth).alias("max_depth"), stats.alias("stats"), *more,
    )
    # one row beside one row
    return total.crossJoin(lost).select(F.lit("metadata").alias("kind"), F.lit(None).cast("bigint").alias("root_id"), to_json(doc).alias("doc"))


def statements_of(statements: DataFrame) -> DataFrame:
    """(node_id, sql): the statements of each data access method in order of their ids."""
    rows = statements.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("stmt_id", "sql_type", "sql_content"))).alias("sql"))
    return rows.select("node_id", "sql")


def downwards(methods: DataFrame, classes: DataFrame, statements: DataFrame, edges: DataFrame, levels_of, max_depth: int) -> DataFrame:
    """The run towards callees; nodes of data access methods carry their statements (node_id, stmt_id, sql_type, sql_content)."""
    start, failed = changed(methods, classes)
    levels = levels_of(start.select("root_id"))
    names = followed(named(methods, classes).join(statements_of(statements), "node_id", "left"), edges)
    facts = trees(start, levels, names, [*[F.col(c) for c in NODE], flag(F.col("is_cyclic")).alias("cyclic"), F.col("sql")])
    doc = F.struct(F.lit("downwards").alias("direction"), "method", F.struct("nodes", "depth", "cyclic", "cut").alias("stats"))
    facts = facts.select("root_id", "nodes", "cyclic", "cut", with_member(to_json(doc), "chain", F.col("tree")).alias("doc"))
    facts = kept(facts, "chains")
    chains = facts.select(F.lit("chain").alias("kind"), "root_id", "doc")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nodes", "cyclic", "cut")]
    return chains.union(failed).union(metadata("downwards", facts.agg(F.count("*").alias("total"), *sums), failed, max_depth, F.struct("nodes", "cyclic", "cut")))


def graph_documents(levels: list[DataFrame], names: DataFrame, api: DataFrame) -> DataFrame:
    """(root_id, doc): the graph of each root's chains as a drawing reads it.

    nodes once each with their least depth, links once each, the categories (kinds of change) met,
    impacted_api_list and the changed methods by kind. names: (node_id, name, change); api: (node_id, api_path).
    """
    rows = reduce(DataFrame.union, [level.select("root_id", "node_id", "parent_id", "depth") for level in levels])
    nodes = rows.groupBy("root_id", "node_id").agg(F.min("depth").alias("level")).join(names, "node_id", "left").join(api, "node_id", "left")
    category = F.coalesce("change", F.lit("UNCHANGED")).alias("category")
    node = F.struct(F.col("node_id").alias("id"), "name", category, "level", "api_path")
    drawn = nodes.groupBy("root_id").agg(
        F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_set(category)).alias("categories"),
        F.array_sort(F.collect_set("api_path")).alias("impacted_api_list"), F.array_sort(F.collect_list(F.when(F.col("change").isNotNull(), F.struct("change", F.col("node_id").alias("id"))))).alias("method_changes"),
    )
    links = rows.filter("parent_id IS NOT NULL AND parent_id <> node_id").select("root_id", F.col("parent_id").alias("source"), F.col("node_id").alias("target")).distinct()
    lines = links.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("links"))
    parts = F.struct("nodes", F.coalesce("links", F.expr("array()")).alias("links"), "categories", "impacted_api_list", "method_changes")
    return drawn.join(lines, "root_id", "left").select("root_id", to_json(parts).alias("doc"))


def boxed_report(levels: list[DataFrame], names: DataFrame, statements: DataFrame, width: int) -> DataFrame:
    """(root_id, report): a line a node in pre-order, indented by depth; below each data access method a box a statement."""
    from ..sources.documents import box, report_line

    rows = reduce(DataFrame.union, [level.select("root_id", "node_id", "path", "depth") for level in levels])
    heads = rows.join(names, "node_id").select("root_id", "path", F.lit(0).cast("bigint").alias("place"), report_line(F.col("depth"), F.col("name"), F.coalesce("change", F.lit("UNCHANGED"))).alias("line"))
    text = F.concat(F.repeat(F.lit("\t"), F.col("depth") + 1), box(F.concat_ws(" ", "sql_type", F.regexp_replace("sql_content", r"\s+", " ")), width))
    boxes = rows.join(statements, "node_id").select("root_id", "path", (F.col("stmt_id") + 1).alias("place"), text.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("path", "place", "line")))
    return heads.union(boxes).groupBy("root_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("report"))
