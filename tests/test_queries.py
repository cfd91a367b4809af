"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from .conftest import SF, TABLES
from ripplecast import registry

registry.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


def test_no_row_is_filtered_away_for_cheapness():
    """Facts read whole tables."""
    from ripplecast.facts import FACTS

    for name, sql in FACTS.items():
        assert "LIMIT" not in sql.replace("LIMIT 1'", "").replace("limit 50'", ""), name
        if name != "method_v":
            assert "WHERE" not in "".join(line for line in sql.split("\n") if line.lstrip().startswith(("FROM", "WHERE"))), name
