"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .facts import Facts, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Facts under o_<name>; sql is the same query for DuckDB over fact names."""

    def add(f: Callable[[Facts], DataFrame]):
        key = f"o_{name}"
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        QUERIES[key].__doc__ = f.__doc__
        if sql:
            SQL[key] = oracle(sql)
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from .plans import changes, chains, files, mutations, projections, projects, relational, results, scalars, service, statements, stored, streams  # noqa: F401
