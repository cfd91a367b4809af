"""Versioned tables: failures in between, odd keys, empty changes, buckets that are read."""

import random

import pytest
from pyspark.sql import functions as F

from ripplecast.sources.versions import VersionedTable

COLUMNS = "k string, v long"


def made(spark, path, rows):
    table = VersionedTable(spark, str(path / "table"), ["k"], 4)
    table.append(spark.createDataFrame(rows, COLUMNS))
    return table


def held(table, version=None):
    return sorted(((r["k"], r["v"]) for r in table.read(version).collect()), key=repr)


def test_a_failed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path, [("a", 1), ("b", 2)])
    monkeypatch.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.replace(spark.createDataFrame([("a", 9)], COLUMNS))
    monkeypatch.undo()
    assert table.versions() == [1] and held(table) == [("a", 1), ("b", 2)]
    (tmp_path / "table/manifest/version=2").mkdir()  # as a job that ended before its file was moved leaves it
    assert table.versions() == [1]
    assert table.replace(spark.createDataFrame([("a", 9)], COLUMNS)) == 2
    assert held(table) == [("a", 9), ("b", 2)] and held(table, 1) == [("a", 1), ("b", 2)]


def test_a_failing_task_leaves_the_last_version(spark, tmp_path):
    table = made(spark, tmp_path, [("a", 1)])
    with pytest.raises(Exception, match="broken"):
        table.append(spark.createDataFrame([("b", 1)], COLUMNS).withColumn("v", F.raise_error(F.lit("broken")).cast("long")))
    assert table.versions() == [1] and held(table) == [("a", 1)]


def test_null_keys_repeated_rows_and_nothing(spark, tmp_path):
    table = made(spark, tmp_path, [(None, 1), (None, 1), ("", 2)])
    nothing = spark.createDataFrame([], COLUMNS)
    for change in (table.append, table.replace, table.insert_absent, table.delete):
        change(nothing)
    assert held(table) == [("", 2), (None, 1), (None, 1)]
    table.insert_absent(spark.createDataFrame([(None, 5), ("n", 6), ("n", 6)], COLUMNS))
    assert held(table) == [("", 2), ("n", 6), ("n", 6), (None, 1), (None, 1)]
    table.replace(spark.createDataFrame([(None, 7)], COLUMNS))
    table.delete(spark.createDataFrame([("n", 0)], COLUMNS))
    assert held(table) == [("", 2), (None, 7)]
    table.delete(spark.createDataFrame([(None, 0), ("", 0)], COLUMNS))
    assert held(table) == [] and len(table.versions()) == 9
    with pytest.raises(ValueError):
        table.update("v > 1", {"k": F.lit("x")})
    with pytest.raises(ValueError):
        table.read(99)
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "none"), ["k"]).read()


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = made(spark, tmp_path, [(str(i), i) for i in range(50)])
    before = {f for f in table.read().inputFiles()}
    table.update("k = '7'", {"v": F.lit(-7)})
    after = {f for f in table.read().inputFiles()}
    part = lambda files: {f.split("bucket_of_row=")[1].split("/")[0] for f in files}
    assert len(part(after - before)) == 1 and part(before) == part(after)


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    table = made(spark, tmp_path, [(str(i), i) for i in range(50)] + [(None, 99)])
    one = table.lookup(spark.createDataFrame([("7", 0), ("7", 1)], COLUMNS))
    assert [tuple(r) for r in one.collect()] == [("7", 7)]
    assert len({f.split("bucket_of_row=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    assert [r["v"] for r in table.lookup(spark.createDataFrame([(None, 0), ("no", 0)], COLUMNS)).collect()] == [99]
    assert table.lookup(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_changes_are_those_of_a_plain_list(spark, tmp_path, seed):
    rng = random.Random(seed)
    some = lambda n: [(rng.choice(["a", "b", "c", None, "hot", "hot"]), rng.randrange(9)) for _ in range(n)]
    rows = some(8)
    table, states = made(spark, tmp_path, rows), [list(rows)]
    for _ in range(5):
        kind, new = rng.choice(["append", "replace", "insert_absent", "delete"]), some(2)
        keys, have = {k for k, _ in new}, {k for k, _ in rows}
        rows = {"append": rows + new, "replace": [r for r in rows if r[0] not in keys] + new, "insert_absent": rows + [r for r in new if r[0] not in have], "delete": [r for r in rows if r[0] not in keys]}[kind]
        getattr(table, kind)(spark.createDataFrame(new, COLUMNS))
        states.append(rows)
    for n, state in enumerate(states, 1):
        assert held(table, n) == sorted(state, key=repr)
