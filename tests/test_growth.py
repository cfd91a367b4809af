"""Steps whose rows must not grow faster than their input, on small cases with known results."""

import random
import re

from pyspark.sql import functions as F

from ripplecast import registry
from ripplecast.operators import graph, impact, lookup, results
from ripplecast.sources import java, javatokens
from ripplecast.streaming import minutes

from .conftest import SF


def test_prefixes_are_counted_without_pairs(spark):
    """100 entries under one short prefix and 100 questions for it: counts as all pairs give them, from 100 rows, not 10,000."""
    asked = spark.createDataFrame([(i, "r", "ab") for i in range(100)] + [(200, "r", "abc01"), (201, "q", "ab"), (202, "r", ""), (203, None, "ab")], "id long, repo string, ref string")
    entries = spark.createDataFrame([("r", f"abc{i:03d}") for i in range(100)] + [("q", "ab")], "repo string, hash string")
    got = lookup.prefix_counts(asked, entries, "repo", "ref", "hash")
    pairs = lookup.prefix_join(asked, entries, "repo", "ref", "hash").collect()
    brute = {}
    for r in pairs:
        brute.setdefault(r.id, []).append(r.hash)
    rows = got.collect()
    assert len(pairs) > 10_000 and len(rows) == 102
    assert {r.id: (r.n, r.hash) for r in rows} == {k: (len(v), min(v)) for k, v in brute.items()}


def test_pairs_of_one_key_are_dealt_over_parts(spark):
    few = spark.createDataFrame([(i, "p") for i in range(40)] + [(50, "q"), (51, None), (52, "z")], "a long, k string")
    many = spark.createDataFrame([(i, "p") for i in range(100)] + [(7, "q"), (8, None)], "b long, k string")
    got = sorted((r.a, r.b, r.k) for r in lookup.split_join(few, many, ["k"], "b", block=16).collect())
    assert got == sorted([(a, b, "p") for a in range(40) for b in range(100)] + [(50, 7, "q")])
    # the pairs are made by a join on the part too, so that one key is no one task
    assert "_part" in lookup.split_join(few, many, ["k"], "b")._jdf.queryExecution().optimizedPlan().toString().split("\n")[1]


def test_components_and_reach(spark):
    """A long cycle, two random graphs and a chain against a search from each node."""
    rng = random.Random(5)
    cycle = [(i, (i + 1) % 40) for i in range(40)] + [(3, 1000), (2000, 7)]
    chain = [(3000 + i, 3001 + i) for i in range(6)] + [(1000, 3000), (3006, 3006)]
    wild = [(5000 + rng.randrange(25), 5000 + rng.randrange(25)) for _ in range(32)]
    pairs = cycle + chain + wild
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    below = {a: reach(a) for a in nodes}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    part = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert set(part) == nodes
    assert all((part[a] == part[b]) == (a == b or (a in below[b] and b in below[a])) for a in nodes for b in nodes)
    got = {r.node: r.n for r in graph.reach_counts(edges, F.col("node") % 3 != 0).collect()}
    assert got == {a: sum(b % 3 != 0 and b != a for b in below[a]) for a in nodes if a % 3}


def test_rounds_leave_nothing_in_the_plan(spark):
    """What the optimizer knows of a round's columns (round is 0 or 1 or 2 ...) is not carried into the next rounds' plans, where it grew until the driver's memory was full."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    got = graph.reached(spark.createDataFrame([(0,)], "node long"), chain)
    assert sorted(tuple(r) for r in got.collect()) == [(i, i) for i in range(10)]
    assert " OR " not in got._jdf.queryExecution().optimizedPlan().constraints().toString()


def test_sets_of_roots(spark):
    """Roots by arrays in two halves against a row a pair in each round."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(80), rng.randrange(80), 1) for _ in range(110)], "src long, dst long, line int").dropDuplicates(["src", "dst"])
    roots = spark.createDataFrame([(i,) for i in range(0, 90, 3)], "root_id long")
    for depth in (1, 5):
        want = sorted(tuple(r) for r in graph.nearest(roots, edges, depth).select("root_id", "node_id", "depth").collect())
        assert sorted(tuple(r) for r in graph.nearest_by_sets(roots, edges, depth).collect()) == want
        of = {}
        for r, n, d in want:
            of.setdefault(n, set()).add((d, r))
        assert {r.node_id: (r.depth, r.root_id) for r in graph.nearest_root(roots, edges, depth).collect()} == {n: min(x) for n, x in of.items()}
        groups = spark.createDataFrame([(i, i % 7) for i in range(90)], "node_id long, group_id long")
        met = {}
        for r, n, _ in want:
            met.setdefault(n % 7, set()).add(r)
        assert {r.group_id: r.roots for r in graph.root_counts(roots, edges, depth, groups).collect()} == {g: len(x) for g, x in met.items()}


def test_tokens_are_sorted_four_times(spark):
    """Brackets are matched while a file is a row; before, each kind of bracket sorted all tokens again, seven times in all."""
    files = spark.createDataFrame([("a", "class A { void f() { g(1); } }")], "path string, text string")
    rows = javatokens.lexed(files)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 4
    got = {(r.t, r.pos): r for r in rows.collect()}
    assert got["g", 8].enc.pos == 7 and got["g", 8].enc.type is None and got["f", 4].enc.type.name == "A" and got["1", 10].paren.pos == 9 and got["g", 8].end.t == ";"


def test_brackets_without_partners(spark):
    """Closing brackets before opening ones, and opening ones that nothing closes."""
    texts = ["} { class A { } ) ( x( y ) { class B { int f() { class C { } } } } ", "", None, "{ { } } class K { class L { } } } class M { }"]
    rows = javatokens.lexed(spark.createDataFrame(list(zip("abcd", texts)), "path string, text string")).filter("t <> '.'").collect()
    types = {(r.path, r.enc.type.name) for r in rows if r.path == "d" and r.enc and r.enc.type}
    assert {r.path for r in rows} == {"a", "d"} and types == {("d", "K"), ("d", "L")}
    for path in "ad":
        curly = 0
        for r in sorted((r for r in rows if r.path == path), key=lambda r: r.pos):
            curly -= r.t == "}"
            assert r.curly == curly
            curly += r.t == "{"


def test_nodes_of_trees_are_moved_once(spark):
    """A root's nodes meet in one exchange, in three levels as in one; before, each level was dealt twice more by the paths of its nodes."""
    roots, edges = spark.createDataFrame([(0,), (1,)], "root_id long"), spark.createDataFrame([(0, 1, 2), (0, 2, None), (0, 3, 1), (1, 0, 5), (3, 0, None)], "src long, dst long, line int")
    made = results.nested(graph.chain_levels(roots, edges, 3), [F.col("node_id").alias("id"), results.flag(F.col("is_cyclic")).alias("cyclic")])
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    back = '{"id":0,"cyclic":true}'
    assert {r.root_id: r.tree for r in made.collect()} == {
        0: f'{{"id":0,"children":[{{"id":3,"children":[{back}]}},{{"id":1,"children":[{back}]}},{{"id":2}}]}}',
        1: '{"id":1,"children":[{"id":0,"children":[{"id":3,"children":[' + back + ']},{"id":1,"cyclic":true},{"id":2}]}]}',
    }


def test_rows_of_a_key_wait_by_minute(spark):
    """Open minutes of one key are dealt over all tasks, each one row in order; before, all of a key's rows waited in one task."""
    calls = spark.sql("SELECT 'k' AS api_key, timestamp_seconds(7 * (id % 40)) AS ts, id % 40 AS event_id, nullif(id % 3, 2) = 0 AS success, 1.0D * (id % 40) AS response_time FROM range(80) WHERE id >= 40 OR id % 2 = 0")
    rows = minutes.closed_minutes(calls, "2 minutes")
    dealt = re.search(r"hashpartitioning\((.*?)\)", rows._jdf.queryExecution().executedPlan().toString())[1]
    assert dealt.count("#") == 2
    got = {r.minute: list(r.response_time) for r in rows.collect()}
    assert got == {m: [float(i) for i in range(40) if 7 * i // 60 == m] for m in range(5)}


def test_pairs_of_a_class_are_not_gathered(spark):
    """Fields and methods of a class are made distinct before they meet; before, all pairs of a task were held by one aggregate over the union."""
    registry.load()
    plan = registry.QUERIES["o_P07_impact_of_objects"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
    fields = spark.createDataFrame([(i, i % 2) for i in range(6)] * 2 + [(9, 7), (10, None)], "field_id long, class_id long")
    methods = spark.createDataFrame([(20 + i, i % 2) for i in range(5)] * 2 + [(30, 7), (31, None)], "method_id long, class_id long")
    classes = spark.createDataFrame([(1,), (1,), (7,), (8,), (None,)], "class_id long")
    got = sorted(tuple(r) for r in impact.same_class(fields, methods, classes).select("object_id", "impacted").collect())
    assert got == sorted([(i, 20 + j) for i in (1, 3, 5) for j in (1, 3)] + [(9, 30)])


def test_tokens_are_moved_with_their_file(spark):
    """Neighbours and numbers of tokens are found while a file is a row: no sort and no window over tokens, one exchange of files; before, four sorts."""
    rows = javatokens.lexed(spark.createDataFrame([("a", "class A { int[] x = {1}; void f() { for (int i = a.b(); ;) { } } }")], "path string, text string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == plan.count("Window [") == 0 and plan.count("Exchange") == 1
    got = {r.pos: r for r in rows.collect()}
    assert [got[i].t for i in sorted(got)] == "class A { int [ ] x = { 1 } ; void f ( ) { for ( int i = a . b ( ) ; ; ) { } } }".split()
    assert (got[1].head.t, got[1].head.name, got[1].end.close, got[1].in_head) == ("class", "A", 33, True) and got[3].head is None and not got[3].in_head
    assert {got[i].run for i in (22, 23, 24)} == {got[22].run} and got[21].stmt != got[17].stmt and got[21].seg == got[27].seg
    assert (got[22].prev, got[22].prev_kind, got[22].next, got[22].next_pos, got[22].paren.pos, got[25].paren.pos) == ("=", "mark", ".", 23, 18, 25)


def test_small_tables_of_sources_are_computed_once(spark):
    """Packages and imports are read from a written table; before, each use of them went over all tokens again."""
    s = java.Source(spark.createDataFrame([("a", "package p; import q.R; class A { R r = new R() { void g() { int no; } }; void f(R s) { int n = 1; r.go(n, (1 + n)); } }")], "path string, text string"))
    for table in (s.packages, s.imports):
        assert "Aggregate" not in table._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, r.rank) for r in s.symbols.collect()) == [("n", 2), ("r", 3), ("s", 1)]
    assert [(r.method_name, r.callee_class) for r in s.resolved_calls.collect()] == [("go", "q.R")]
    assert [r.types for r in s.argument_types.collect()] == ["int,String"]


def test_pairs_of_roots_and_nodes_are_moved_as_bare_ids(spark):
    """Every node has two callers, as in the facts: what is shuffled for a pair of the result is little more than its id. Ids that are no int, and null ones, give the same rows as a row a pair."""
    n, depth = 4000, 6
    edges = spark.range(n).select("id", F.explode(F.array(F.lit(1), F.lit(18))).alias("b")).select(((F.col("id") * 31 + F.col("b")) % n).alias("src"), F.col("id").alias("dst"))
    roots = spark.range(0, n, 4).select(F.col("id").alias("root_id"))
    # accumulates over the session: what this run adds
    moved = lambda: sum(e.totalShuffleWrite() for e in executors())
    store = spark.sparkContext._jsc.sc().statusStore()

    def executors():
        found = store.executorList(False)
        return [found.apply(i) for i in range(found.size())]

    before = moved()
    rows = graph.nearest_by_sets(roots, edges, depth).agg(F.count("*").alias("n"), F.sum(F.hash("root_id", "node_id", "depth")).alias("all")).first()
    bytes_moved = moved() - before
    want = graph.nearest(roots, edges, depth).select("root_id", F.col("node_id"), "depth").agg(F.count("*").alias("n"), F.sum(F.hash("root_id", "node_id", "depth")).alias("all")).first()
    assert rows == want and rows.n > 100_000
    assert bytes_moved < 20 * rows.n
    far = spark.createDataFrame([(1 << 40, 2 << 40), (2 << 40, -5), (-5, 1 << 40), (-5, 7), (7, None), (None, 8), (8, 8)], "src long, dst long")
    for start in ([1 << 40, -5], [8], []):
        begin = spark.createDataFrame([(i,) for i in start], "root_id long")
        for depth in (1, 3, 7):
            got, known = (sorted(map(str, f(begin, far, depth).select("root_id", "node_id", "depth").collect())) for f in (graph.nearest_by_sets, graph.nearest))
            assert got == known
