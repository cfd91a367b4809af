"""Operators and functions on small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from ripplecast.functions import names as N
from ripplecast.functions import sqltext as S
from ripplecast.operators import graph, impact, lookup
from ripplecast.sources import diffs, documents, java, mappers
from ripplecast.operators.ranks import ranked
from ripplecast.streaming import health


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_short_tags(spark):
    cases = {
        "SHAb42d_20231225_01": "SHAb42d_20231225_01", "mall_SHAb42d_20231225_01": "SHAb42d_20231225_01", "dd6569c3558f79af5b21aad601349e0f029b9a6d": "dd6569c3",
        "MIX_LJ01.ONB_ONB4_pipe_st_2_ST_00.03.05_SUMMER_20260506_01": "SHA3afe_20260506_01", "MIX_LJ01.ONB_ONB4_pipe_st_2_ST_00.03.06_SUMMER_20260506_01": "SHA6436_20260506_01", "v1": "v1", None: "",
    }
    assert column(spark, list(cases), N.short_tag) == list(cases.values())
    assert column(spark, list(cases.values()), N.short_tag) == list(cases.values())


def test_signature_types(spark):
    sigs = ["process(List<String>,Map<String,Integer>)", "f()", "g(int)", "h(Map<A,Map<B,C>>,int[])"]
    assert column(spark, sigs, N.types_of_signature) == [["List<String>", "Map<String,Integer>"], [], ["int"], ["Map<A,Map<B,C>>", "int[]"]]


def test_thinking_blocks(spark):
    texts = ["<think>a<think>b</think>c</think>\n\n\n\nx", "a\n\n\n\nb", "<think>open x", None, "", "  y  "]
    assert column(spark, texts, N.without_thinking) == ["x", "a\n\nb", "open x", None, "", "y"]


def test_sql_text(spark):
    sql = ["UPDATE t SET a = 1", "SELECT t.a, b AS c FROM t LIMIT 10", "select 1", "", None]
    assert column(spark, sql, S.tables) == [["t"], ["t"], [], [], []]
    assert column(spark, sql[:2], lambda c: S.fields(c, F.when(c.startswith("U"), "UPDATE").otherwise("SELECT"))) == [["a"], ["a", "b"]]
    assert column(spark, sql[1:2], lambda c: S.fields(c, F.lit("SELECT"), compat=True)) == [["t", "b"]]


def walk(root, edges, depth):
    out, todo = [], [(root,)]
    while todo:
        path = todo.pop()
        out.append(path)
        if path[-1] not in path[:-1] and len(path) <= depth:
            todo += [(*path, d) for s, d in edges if s == path[-1]]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_chains_against_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(10)})
    df = spark.createDataFrame([(*e, 1) for e in edges], "src long, dst long, line int")
    roots = spark.createDataFrame([(r,) for r in range(3)], "root_id long")
    got = sorted(tuple(r.path) for r in graph.chains(roots, df, 4).collect())
    assert got == sorted(p for r in range(3) for p in walk(r, edges, 4))


def test_levels_closure_fixpoint(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("B", "D")], "src string, dst string")
    assert dict(graph.levels(edges).collect()) == {"A": 0, "B": 1, "C": 2, "D": 3}
    assert {(r.src, r.dst): r.distance for r in graph.closure(edges).collect()} == {("A", "B"): 1, ("B", "C"): 1, ("C", "D"): 1, ("B", "D"): 1, ("A", "C"): 2, ("A", "D"): 2}
    cycle = edges.union(spark.createDataFrame([("D", "A")], edges.schema))
    assert {r.node for r in graph.reached(spark.createDataFrame([("B",)], "node string"), cycle).collect()} == set("ABCD")
    with pytest.raises(ValueError):
        graph.levels(cycle)


def test_merge_keeps_increment(spark):
    base = spark.createDataFrame([(1, "a", "UNCHANGED"), (2, "a", None), (3, "b", "DELETED"), (4, "c", None)], "id int, k string, change_type string")
    inc = spark.createDataFrame([(9, "a", "MODIFIED")], base.schema)
    assert sorted(r.id for r in lookup.merge_versions(base, inc, ["k"]).collect()) == [4, 9]


def test_ranges_meet_over_blocks(spark):
    lines = spark.createDataFrame([(1, n) for n in (5, 64, 200)], "class_id int, line_no int")
    ranges = spark.createDataFrame([(1, 1, 130, 7), (1, 64, 64, 8), (2, 1, 999, 9)], "class_id int, start_line int, end_line int, method_id int")
    assert sorted((r.line_no, r.method_id) for r in lookup.lines_in_ranges(lines, ranges).collect()) == [(5, 7), (64, 7), (64, 8)]


def test_diff_of_other_files_is_skipped(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n--- a/src/test/T.java\n+++ b/src/test/T.java\n@@ -1 +1 @@\n+c\n--- a/A.java\n+++ b/A.java\n@@ -3,2 +4,2 @@\n x\n-y\n+z\n"
    df = spark.createDataFrame([(1, text), (2, None)], "diff int, text string")
    assert sorted((r.path, r.op, r.line_no, r.content) for r in diffs.changed_lines(df).collect()) == [("A.java", "+", 5, "z"), ("A.java", "-", 4, "y")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "UserMapper.xml").write_text('<mapper namespace="n"><update id="u">UPDATE t <set>a = 1</set></update></mapper>')
    (tmp_path / "other.xml").write_text("<a/>")
    (tmp_path / "A.java").write_text("package p;\npublic class A {\n  int x;\n}\n")
    files = mappers.read_mappers(spark, str(tmp_path))
    assert [(r.full_method, r.sql_content) for r in mappers.statements(files).collect()] == [("n.u", "UPDATE t SET a = 1")]
    assert [r.class_name for r in java.Source(java.read_sources(spark, str(tmp_path))).classes.collect()] == ["A"]
    rows = spark.createDataFrame([(1, "a", "UNCHANGED"), (2, "b", "ADDED")], "id int, m string, c string")
    documents.write_documents(rows.withColumn("c", F.nullif("c", F.lit("UNCHANGED"))), str(tmp_path / "out"), ["id"])
    back = documents.read_documents(spark, str(tmp_path / "out"), "id int, m string, c string", {"c": "UNCHANGED"})
    assert sorted(tuple(r) for r in back.select("id", "m", "c").collect()) == [(1, "a", "UNCHANGED"), (2, "b", "ADDED")]


def calls(n=400):
    rng = random.Random(5)
    return [(i, f"k{rng.randrange(3)}", rng.random() > (0.95 if 100 < i < 180 else 0.3), rng.random()) for i in range(n)]


def folded(rows):
    out = {}
    for _, k, ok, took in rows:
        out[k] = health.step(out.get(k, health.start_state()), ok, took)
    return out


def log(spark, rows):
    return spark.createDataFrame(rows, "event_id long, api_key string, success boolean, response_time double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 7))


def test_health_is_the_plain_fold(spark):
    want = folded(calls())
    got = {r.api_key: tuple(r)[1:] for r in health.final_health(log(spark, calls())).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    means = {r.api_key: r.average for r in health.averages(log(spark, calls())).collect()}
    assert means == {k: pytest.approx(v[3]) for k, v in want.items()}


def test_health_by_blocks_of_any_size(spark, monkeypatch):
    # long runs of failures over many blocks, ties in time and a null success
    rng = random.Random(9)
    many = [(i, f"k{rng.randrange(2)}", None if i == 7 else rng.random() > (0.98 if i % 300 > 150 else 0.4), rng.random()) for i in range(1500)]
    rows = log(spark, many).withColumn("ts", F.timestamp_seconds(F.floor(F.col("event_id") / 3) * 25))
    monkeypatch.setattr(health, "FOLD", 7)
    want = folded((i, k, bool(ok), took) for i, k, ok, took in many)
    assert {r.api_key: tuple(r)[1:] for r in health.final_health(rows).collect()} == {k: pytest.approx(v) for k, v in want.items()}
    runs, now = {}, {}
    for i, k, ok, _ in many:
        runs[k, i] = now[k] = 0 if ok else now.get(k, 0) + 1
    assert {(r.api_key, r.event_id): r.run for r in health.failure_runs(rows).collect()} == runs
    assert health.final_health(rows.limit(0)).collect() == []


def test_ranks_by_blocks(spark):
    rows = [(None if i % 7 == 0 else i % 3, i * 37 % 501) for i in range(501)]
    got = ranked(spark.createDataFrame(rows, "k int, id long"), ["k"], ["id"], F.floor(F.col("id") / 50)).collect()
    groups = {k: sorted(i for g, i in rows if g == k) for k in {k for k, _ in rows}}
    assert sorted((r.id, r.place) for r in got) == sorted((i, n + 1) for ids in groups.values() for n, i in enumerate(ids))


def test_stream_replays_the_batch(spark, tmp_path):
    rows = log(spark, calls(120))
    for part in range(3):
        rows.filter(F.floor(F.col("event_id") / 40) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = health.minute_counts(stream(), "60 seconds").writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.api_key, r.window_start, r.total, r.ok, r.failed) for r in df.collect())
    assert key(spark.table("minutes")) == key(health.minute_counts(rows))
    q = health.streaming_health(stream()).writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("health").collect():
        if r.api_key not in last or r.calls > last[r.api_key].calls:
            last[r.api_key] = r
    assert {k: tuple(r)[1:] for k, r in last.items()} == {k: pytest.approx(v) for k, v in folded(calls(120)).items()}


def test_saved_json_is_loaded_where_it_is(spark, tmp_path):
    assert documents.load_json(spark, str(tmp_path / "none"), "a long").count() == 0
    spark.range(3).select(F.col("id").alias("a")).write.json(str(tmp_path / "some"))
    assert sorted(r.a for r in documents.load_json(spark, str(tmp_path / "some"), "a long").collect()) == [0, 1, 2]


def test_prefix_and_suffix_joins_are_equi_joins(spark):
    asked = spark.createDataFrame([(1, "r", "ab"), (2, "r", "abc"), (3, "s", "ab"), (4, "r", ""), (5, "r", None), (6, "r", "abcdefgh")], "id int, repo string, ref string")
    entries = spark.createDataFrame([("r", "abcd"), ("r", "abxx"), ("s", "zz"), (None, "ab")], "repo string, hash string")
    got = lookup.prefix_join(asked, entries, "repo", "ref", "hash")
    assert sorted((r.id, r.hash) for r in got.collect()) == [(1, "abcd"), (1, "abxx"), (2, "abcd")]
    paths = spark.createDataFrame([("b.java",), ("a/b.java",), ("x/a/b.java",), ("java",)], "path string")
    files = spark.createDataFrame([("x/a/b.java",), ("a/b.java",), ("xa/b.java",), ("b.java",)], "file string")
    ends = lookup.suffix_join(paths, files, "path", "file")
    assert sorted(tuple(r) for r in ends.select("path", "file").collect()) == sorted((p, x) for (p,) in paths.collect() for (x,) in files.collect() if x == p or x.endswith("/" + p))
    assert lookup.suffix_join(paths.limit(0), files, "path", "file").count() == 0
    for plan in (got, ends):
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_odd_java_sources(spark):
    """Null and empty files, unbalanced brackets, unended comments, records, nested and local types."""
    texts = [
        None, "", "}}} ) class", "package p; class A { void a( { } /* no end", 'class B { String s = "{"; char c = \'\\\'\'; void b() { } }', "record R(int a, String b) { R { } int sum() { return a; } }",
        "enum E { X(1) { void in() { } }, Y; E(int... n) { } static class N { class M { void m() { class L { void l() { } } } } } }", "@interface T { String value() default \"}\"; }",
    ]
    s = java.Source(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string"))
    assert sorted((r.path, r.class_name, r.outer) for r in s.types.collect()) == [("f3", "A", None), ("f4", "B", None), ("f5", "R", None), ("f6", "E", None), ("f6", "M", "N"), ("f6", "N", "E"), ("f7", "T", None)]
    found = {(r.path, r.class_name, r.method_name, r.parameters) for r in s.methods.collect()}
    assert {("f4", "B", "b", ""), ("f5", "R", "sum", ""), ("f6", "E", "E", "int"), ("f6", "M", "m", ""), ("f7", "T", "value", "")} <= found
    assert not {"l", "in", "X"} & {m[2] for m in found}
    assert sorted(r.field_name for r in s.enum_constants.collect()) == ["X", "Y"]
    assert s.resolved_calls.count() == 0
    assert {r.path for r in s.packages.filter("package_name = 'unknown'").collect()} == {"f0", "f1", "f2", "f4", "f5", "f6", "f7"}


def test_nearest_and_typed_reach(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (5, 5)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, line int")
    got = graph.nearest(spark.createDataFrame([(1,), (5,)], "root_id long"), df, 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (5, 5, 0)]
    steps = spark.createDataFrame([("class", 1, "field", 1), ("field", 1, "method", 7), ("method", 7, "method", 8), ("method", 8, "method", 7), ("field", 8, "method", 9)], "src_kind string, src long, dst_kind string, dst long")
    start = spark.createDataFrame([("class", 1), ("class", 1)], "kind string, id long")
    assert sorted(tuple(r) for r in impact.reached(start, steps).collect()) == [("class", 1, 0), ("field", 1, 1), ("method", 7, 2), ("method", 8, 3)]


def test_folder_names_stay_text(spark, tmp_path):
    from ripplecast.sources import folders

    names = ["00123456", "12e45678", "v1", "a:b"]
    spark.createDataFrame([(n, 1) for n in names], "short string, v int").write.partitionBy("short").parquet(str(tmp_path / "t"))
    assert sorted(r[0] for r in folders.catalogue(spark, str(tmp_path / "t"), "short").collect()) == sorted(names)
