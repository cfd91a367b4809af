"""Graph operators on edge tables: chains with paths, closures, fixpoints, levels.

Iterations are loops over joins that end when a round brings nothing new. Each round's rows are written to the shared
checkpoint folder, so a plan never grows with the rounds and no rows come to the driver but
a count.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import kept, written


def chain_levels(roots: DataFrame, edges: DataFrame, max_depth: int, ranked: bool = True) -> list[DataFrame]:
    """All paths from each root along (src, dst, line) edges, a row for each node of each path, a table for each depth.

    roots: (root_id). A path ends where it meets a node that it already holds (is_cyclic) or at
    max_depth. Rows: root_id, depth, node_id, parent_id, line, path (ids from the root) and
    is_cyclic. Paths are kept apart, as a node may be reached in several ways. ranked adds ranks: of each step of the path,
    its place among all from the same node by (line, node_id), without a line last; so a root's rows in order of ranks are its tree in pre-order.
    """
    kind = edges.schema["dst"].dataType
    none, step = [], []
    if ranked:
        siblings = Window.partitionBy("src").orderBy(F.asc_nulls_last("line"), "dst")
        edges = written(edges.select("src", "dst", "line", F.row_number().over(siblings).alias("rank")))
        none, step = [F.array().cast("array<int>").alias("ranks")], [F.array_append("ranks", F.col("rank")).alias("ranks")]
    level = roots.select(
        "root_id", F.lit(0).alias("depth"), F.col("root_id").cast(kind).alias("node_id"), F.lit(None).cast(kind).alias("parent_id"), F.lit(None).cast("int").alias("line"),
        F.array(F.col("root_id").cast(kind)).alias("path"), F.lit(False).alias("is_cyclic"), *none,
    )
    levels = [level]
    for depth in range(1, max_depth + 1):
        open_ends = level.filter("NOT is_cyclic").select("root_id", F.col("node_id").alias("src"), "path", *(["ranks"] if ranked else []))
        level = written(
            open_ends.join(edges, "src").select(
                "root_id", F.lit(depth).alias("depth"), F.col("dst").alias("node_id"), F.col("src").alias("parent_id"), "line",
                F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("is_cyclic"), *step,
            )
        )
        levels.append(level)
    return levels


def chains(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The rows of chain_levels in one table."""
    return reduce(DataFrame.union, chain_levels(roots, edges, max_depth, ranked=False))


def nearest(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(root_id, node_id, depth): the nodes that chains from each root hold, with their least depth, by breadth-first search.

    A node that a walk of some length reaches is also reached by a path that holds no node twice and is no longer, so the
    paths need not be kept: a round has a row for each root and node at most, however many ways there are. edges are
    read once a round.
    """
    kind = edges.schema["dst"].dataType
    found = fresh = roots.select("root_id", F.col("root_id").cast(kind).alias("node_id"), F.lit(0).alias("depth")).distinct()
    for depth in range(1, max_depth + 1):
        met = fresh.select("root_id", F.col("node_id").alias("src")).join(edges, "src").select("root_id", F.col("dst").alias("node_id")).distinct()
        fresh = written(met.join(found, ["root_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.union(fresh)
    return found


def root_sets(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node_id, levels): a row a node that roots reach within max_depth steps, with an array of roots for each distance from 0 to max_depth.

    A round sends each node's newest roots along its edges as one array, so it costs a row an edge.
    """
    kind = edges.schema["dst"].dataType
    start = roots.select(F.col("root_id").cast(kind).alias("node_id")).distinct()
    now = written(start.select("node_id", F.array(F.array("node_id")).alias("levels")))
    sets, ids = now.schema["levels"].dataType, now.schema["levels"].dataType.elementType
    for depth in range(1, max_depth + 1):
        sent = now.select(F.col("node_id").alias("src"), F.element_at("levels", -1).alias("fresh")).filter(F.size("fresh") > 0).join(edges.select("src", "dst"), "src")
        both = now.withColumn("fresh", F.lit(None).cast(ids)).union(sent.select("dst", F.lit(None).cast(sets), "fresh"))
        met = both.groupBy("node_id").agg(F.first("levels", ignorenulls=True).alias("levels"), F.flatten(F.collect_list("fresh")).alias("met"))
        met = met.withColumn("levels", F.coalesce("levels", F.array_repeat(F.lit([]).cast(ids), depth)))
        now = written(met.select("node_id", F.array_append("levels", F.array_except("met", F.flatten("levels"))).alias("levels")))
    return now


def walk_starts(edges: DataFrame, steps: int) -> DataFrame:
    """(node_id, src): the nodes that walks of exactly so many steps to each node start from; a node may be nearer than that, too."""
    now = edges.select(F.col("src").cast(edges.schema["dst"].dataType).alias("node_id")).distinct().select("node_id", F.array("node_id").alias("starts"))
    for _ in range(steps):
        sent = now.select(F.col("node_id").alias("src"), "starts").join(edges.select("src", "dst"), "src")
        now = written(sent.groupBy(F.col("dst").alias("node_id")).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))
    return now.select("node_id", F.explode("starts").alias("src"))


def narrowed(roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots (root_id) and edges (src, dst) with ids as int where they are long and all fit, since sets of ids are most of what is moved."""
    if any(df.schema[c].dataType != LongType() for df, c in ((roots, "root_id"), (edges, "src"), (edges, "dst"))):
        return roots, edges
    ids = edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).union(roots.select("root_id", "root_id"))
    low, high = ids.agg(F.min("low"), F.max("high")).first()
    if low is None or low < -(1 << 31) or high >= 1 << 31:
        return roots, edges
    return roots.select(F.col("root_id").cast("int")), edges.select(F.col("src").cast("int"), F.col("dst").cast("int"))


def meetings(roots: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame, int]:
    """Chains of up to max_depth steps in two parts: root_sets of the first part, and (node_id, src) of the nodes that are the last part before each node.

    A root that is farther from a node than the first part is as near as that to one of these, so a node's roots are
    those of its own set and of theirs; the third value is the last part's length. It is a third of the way: a node gets few sets then,
    and sets of many ids, so that little but ids is moved. Ids may be narrowed.
    """
    rest = max_depth // 3
    roots, edges = narrowed(roots, edges)
    return root_sets(roots, edges, max_depth - rest), walk_starts(edges, rest), rest


def root_counts(roots: DataFrame, edges: DataFrame, max_depth: int, groups: DataFrame) -> DataFrame:
    """(group_id, roots): how many distinct roots reach some node of a group within max_depth steps; groups: (node_id, group_id).

    Neither the pairs of roots and nodes nor those of roots and groups are made rows: what is shuffled is an array for
    each group and node that the last part of a chain to it starts from.
    """
    near, ends, _ = meetings(roots, edges, max_depth)
    sets = near.select("node_id", F.flatten("levels").alias("roots"))
    asked = ends.join(groups, "node_id").select("group_id", "src").union(groups.select("group_id", F.col("node_id").alias("src"))).distinct()
    met = asked.join(sets.withColumnRenamed("node_id", "src"), "src").groupBy("group_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("roots")))).cast("long").alias("roots"))
    return met.filter("roots > 0")


def nearest_by_sets(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The rows of nearest, for many roots and long chains: two parts of arrays in place of a row a pair in each round.

    A pair of a root and a node is moved once for each node in the middle between them, as one id in an array by distance.
    """
    kind = edges.schema["dst"].dataType
    near, starts, rest = meetings(roots, edges, max_depth)
    part, sets = max_depth - rest, near.schema["levels"].dataType
    # nearer roots are in the end's own set
    sent = near.select(F.col("node_id").alias("src"), F.slice("levels", part - rest + 2, rest).alias("far")).filter(F.size(F.flatten("far")) > 0)
    far = starts.join(sent, "src").select("node_id", F.lit(None).cast(sets).alias("levels"), "far")
    met = near.withColumn("far", F.lit(None).cast(sets)).union(far).groupBy("node_id").agg(F.first("levels", ignorenulls=True).alias("levels"), F.collect_list("far").alias("far"))
    met = met.withColumn("levels", F.coalesce("levels", F.array_repeat(F.lit([]).cast(sets.elementType), part + 1)))
    for i in range(rest):
        ids = F.flatten(F.transform("far", lambda x: x[i]))  # noqa: B023
        met = met.withColumn("levels", F.array_append("levels", F.array_except(ids, F.flatten("levels"))))
    rows = met.select("node_id", F.posexplode("levels").alias("depth", "ids")).select(F.explode("ids").alias("root_id"), "node_id", "depth")
    return rows.select(F.col("root_id").cast(kind), F.col("node_id").cast(kind), "depth")


def nearest_root(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node_id, depth, root_id): the nearest root of each node within max_depth steps, of equally near ones the least."""
    kind = edges.schema["dst"].dataType
    found = fresh = roots.select(F.col("root_id").cast(kind).alias("node_id"), F.lit(0).alias("depth"), "root_id").distinct()
    for depth in range(1, max_depth + 1):
        met = fresh.select("root_id", F.col("node_id").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node_id")).agg(F.lit(depth).alias("depth"), F.min("root_id").alias("root_id"))
        fresh = written(met.join(found, "node_id", "left_anti"))
        found = found.union(fresh)
    return found


def depth_limited(rows: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Paths cut at max_depth although their end has a further edge: (root_id, cut paths)."""
    ends = rows.filter((F.col("depth") == max_depth) & ~F.col("is_cyclic"))
    more = edges.select(F.col("src").alias("node_id")).distinct()
    return ends.join(more, "node_id", "left_semi").groupBy("root_id").agg(F.count("*").alias("cut"))


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def round_rows(df: DataFrame) -> DataFrame:
    """A round's rows as files; a checkpoint would carry on what the optimizer infers of its columns, which grows from round to round in the driver."""
    return kept(df, "round")


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure of (src, dst) with the least distance, by semi-naive rounds until nothing is new."""
    found = fresh = round_rows(edges.filter("src <> dst").select("src", "dst", F.lit(1).alias("distance")).dropDuplicates(["src", "dst"]))
    for distance in count(2):
        step = fresh.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").filter("src <> dst").select("src", "dst").distinct()
        fresh = round_rows(step.join(found, ["src", "dst"], "left_anti").withColumn("distance", F.lit(distance)))
        if fresh.isEmpty():
            return found
        found = round_rows(found.union(fresh)) if distance % 8 == 0 else found.union(fresh)


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, round) reachable from start (node) along (src, dst), each with the round it was first met."""
    found = fresh = round_rows(start.select("node").distinct().withColumn("round", F.lit(0)))
    for n in count(1):
        step = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = round_rows(step.join(found, "node", "left_anti").withColumn("round", F.lit(n)))
        if fresh.isEmpty():
            return found
        found = round_rows(found.union(fresh)) if n % 8 == 0 else found.union(fresh)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected components of (src, dst); a component is named by one of its nodes.

    Each node takes the greatest colour of the nodes that lead to it; of those of one colour, the ones that lead back to
    the colour's own node are its component, and the rest goes on. Colours are ordered by a hash. Nodes with one way on
    get shortcuts of 2, 4, 8, ... steps first, so that long cycles and chains take few rounds.
    """
    nodes = round_rows(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    steps = jump = round_rows(edges.filter("src <> dst").select("src", "dst").distinct())
    jump = round_rows(jump.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).filter("n = 1").drop("n"))
    for _ in range(max(jump.count() - 1, 0).bit_length()):
        jump = round_rows(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("on")), "dst").select("src", F.col("on").alias("dst")))
        steps = steps.union(jump.filter("src <> dst"))
    steps, out = round_rows(steps.distinct()), None
    colour = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))
    while True:
        now = round_rows(nodes.select("node", colour.alias("colour"), F.lit(True).alias("moved")))
        while not now.filter("moved").isEmpty():
            met = now.filter("moved").join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("met"))
            now = round_rows(now.join(met, "node", "left").select("node", F.greatest("colour", F.coalesce("met", "colour")).alias("colour"), F.coalesce(F.col("met") > F.col("colour"), F.lit(False)).alias("moved")))
        named = now.select("node", F.col("colour.node").alias("component"))
        inner = steps.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = reached(named.filter("node = component").select("node"), round_rows(inner)).select("node")
        done = round_rows(named.join(back, "node", "left_semi"))
        out = done if out is None else out.union(done)
        nodes = round_rows(named.join(back, "node", "left_anti").select("node"))
        if nodes.isEmpty():
            return out
        steps = round_rows(steps.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))


def reach_counts(edges: DataFrame, counted) -> DataFrame:
    """(node, n): how many other counted nodes can be reached from each counted one; counted: a condition on node.

    Nodes of one strongly connected component reach the same nodes, so only components are followed and their sizes summed.
    """
    parts = round_rows(strong_components(edges))
    sizes = parts.groupBy("component").agg(F.count_if(counted).alias("size"))
    between = edges.join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    below = closure(round_rows(between)).join(sizes, F.col("dst") == F.col("component")).groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("more"))
    rows = parts.filter(counted).join(sizes, "component").join(below, "component", "left")
    return rows.select("node", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n"))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest path to each node of an acyclic graph; a cycle is an error."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = round_rows(nodes.withColumn("level", F.lit(0)))
    for _ in range(now.count() + 1):
        raised = edges.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("up"))
        then = round_rows(now.join(raised, "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.coalesce("up", F.lit(0)) > F.col("level")).alias("moved")))
        if then.filter("moved").isEmpty():
            return then.select("node", "level")
        now = then.select("node", "level")
    raise ValueError("the graph has a cycle")
