"""Nested result documents against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ripplecast.operators import graph, results

METHODS = "method_id long, class_id long, method_name string, parameters string, change_type string, is_api boolean, annotation string"


def tree(node, edges, depth, path=()):
    cyclic = node in path
    out = {"id": node, "cyclic": True} if cyclic else {"id": node}
    steps = [] if cyclic or depth == 0 else sorted((line if line is not None else 2**31, d) for s, d, line in edges if s == node)
    if steps:
        out["children"] = [tree(d, edges, depth - 1, (*path, node)) for _, d in steps]
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("top", [0, 1])
def test_trees_are_those_of_plain_recursion(spark, seed, top):
    rng = random.Random(seed)
    edges = [(s, d, rng.choice([None, 1, 2, 3])) for s, d in sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(11)})]
    levels = graph.chain_levels(spark.createDataFrame([(0,), (1,), (9,)], "root_id long"), spark.createDataFrame(edges, "src long, dst long, line int"), 3)
    made = results.nested(levels, [F.col("node_id").alias("id"), results.flag(F.col("is_cyclic")).alias("cyclic")], top).collect()
    plain = {(r,): tree(r, edges, 3) for r in (0, 1, 9)}
    if top:
        plain = {(*k, c["id"]): c for k, t in plain.items() for c in t.get("children", [])}
    assert {tuple(r["path"]): json.loads(r["tree"]) for r in made} == plain


def run(spark, methods, classes, edges):
    m, c = spark.createDataFrame(methods, METHODS), spark.createDataFrame(classes, "class_id long, class_name string, change_type string")
    e = spark.createDataFrame(edges, "src long, dst long, line int")
    return results.upwards(m, c, e, lambda roots: graph.chain_levels(roots, e, 3), 3).collect()


def test_run_with_failures_and_odd_rows(spark):
    """A deleted class, a class that is not there, quotes in names, null parameters, an unchanged method, no callers."""
    methods = [(1, 1, 'a"b', None, "ADDED", False, ""), (2, 2, "gone", "int", "MODIFIED", True, ""), (3, 9, "lost", "", "ADDED", False, ""), (4, 1, "same", "", "UNCHANGED", True, None)]
    rows = run(spark, methods, [(1, "C1", "ADDED"), (2, "C2", "DELETED")], [(1, 4, 7), (4, 1, None)])
    docs = {(r["kind"], r["root_id"]): json.loads(r["doc"]) for r in rows}
    assert set(docs) == {("chain", 1), ("failed", 2), ("failed", 3), ("metadata", None)}
    chain = docs["chain", 1]
    assert chain["chain"] == {"node_id": 1, "name": 'C1.a"b', "change": "ADDED", "children": [{"node_id": 4, "name": "C1.same", "line": 7, "entry": "HTTP_API", "children": [{"node_id": 1, "name": 'C1.a"b', "change": "ADDED", "cyclic": True}]}]}
    assert chain["entry_points"] == [{"node_id": 4, "entry": "HTTP_API", "depth": 1}]
    assert chain["limitations"] == ["CYCLE_DETECTED"] and chain["has_incomplete_paths"]
    meta = docs["metadata", None]
    assert (meta["total_methods"], meta["successful_chains"], meta["failed_chains"]) == (3, 1, 2)
    assert meta["recommendations"] == ["COMPLETE"] and meta["stats"]["coverage"] == 100.0


def test_run_over_nothing(spark):
    rows = run(spark, [], [], [])
    assert [r["kind"] for r in rows] == ["metadata"]
    meta = json.loads(rows[0]["doc"])
    assert meta["total_methods"] == 0 and meta["recommendations"] == ["LOW_COVERAGE"]
