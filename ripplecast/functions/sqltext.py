"""Columns on the text of SQL statements: tables, risk, performance rules, fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words and limits that results depend on.
TABLE_PATTERNS = [
    "(?is)(?:FROM|INTO|UPDATE)\\s+[`\"']?(\\w+)[`\"']?",
    "(?is)(?:JOIN)\\s+[`\"']?(\\w+)[`\"']?(?:\\s+\\w+)?(?:\\s+(?:ON|USING|,)|$)",
    "(?is)(?:FROM|JOIN)\\s*\\(\\s*SELECT.*?FROM\\s+[`\"']?(\\w+)[`\"']?",
]
NOT_TABLES = [
    "SELECT", "WHERE", "AND", "OR", "SET", "VALUES", "GROUP", "ORDER", "BY", "HAVING", "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT",
    "CASE", "WHEN", "THEN", "END", "IF", "ELSE", "NULL", "NOT", "IN", "EXISTS", "BETWEEN", "LIKE", "IS", "AS", "ON",
]
PENALTIES = {"HIGH": 20, "MEDIUM": 10, "LOW": 5}
LEVELS = [(90, "EXCELLENT"), (70, "GOOD"), (50, "FAIR")]


def tables(sql: Column) -> Column:
    """Sorted distinct names after FROM, INTO, UPDATE and JOIN that are not SQL words."""
    found = F.concat(*[F.regexp_extract_all(sql, F.lit(p), F.lit(1)) for p in TABLE_PATTERNS])
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda t: ~F.upper(t).isin(NOT_TABLES)))), F.array().cast("array<string>"))


def _has(sql: Column, word: str) -> Column:
    return F.upper(sql).contains(word)


def has_where(sql: Column, kind: Column) -> Column:
    return F.when(F.coalesce(sql, F.lit("")) == "", False).when(kind.isin("SELECT", "UPDATE", "DELETE"), _has(sql, "WHERE")).otherwise(True)


def has_limit(sql: Column) -> Column:
    return F.coalesce(_has(sql, "LIMIT") | _has(sql, "ROWNUM") | _has(sql, "FETCH FIRST"), F.lit(False))


def _batch(sql: Column) -> Column:
    return sql.contains("<foreach>") | sql.contains("FOREACH")


def estimated_rows(sql: Column, kind: Column) -> Column:
    """ONE, FEW, MANY, ALL or UNKNOWN."""
    limit = F.regexp_extract(F.upper(sql), "LIMIT\\s+(\\d+)", 1)
    n = limit.try_cast("long")
    return (
        F.when(F.coalesce(sql, F.lit("")) == "", "UNKNOWN")
        .when(kind.isin("DELETE", "UPDATE") & ~has_where(sql, kind), "ALL")
        .when(has_limit(sql), F.when(n == 1, "ONE").when((limit == "") | (n <= 10), "FEW").otherwise("MANY"))
        .when((kind == "SELECT") & has_where(sql, kind), F.when(sql.rlike("WHERE\\s+\\w+\\s*=\\s*#\\{"), "ONE").otherwise("MANY"))
        .when(kind == "INSERT", F.when(_batch(sql), "MANY").otherwise("ONE"))
        .otherwise("UNKNOWN")
    )


def risk_level(sql: Column, kind: Column) -> Column:
    where = _has(sql, "WHERE")
    return (
        F.when(kind.isin("DELETE", "UPDATE") & ~where, "CRITICAL").when(kind == "DELETE", "HIGH").when(kind == "UPDATE", "MEDIUM")
        .when((kind == "SELECT") & ~where & ~_has(sql, "LIMIT"), "MEDIUM").otherwise("LOW")
    )


def warning_codes(sql: Column, kind: Column, dynamic: Column) -> Column:
    """Codes of what there is to warn of, in the order of a report."""
    where = _has(sql, "WHERE")
    rules = [
        (kind == "DELETE", "DELETE_AFFECTS"), ((kind == "DELETE") & ~where, "DELETE_WITHOUT_WHERE"), ((kind == "UPDATE") & ~where, "UPDATE_WITHOUT_WHERE"),
        ((kind == "UPDATE") & where, "UPDATE_AFFECTS"), ((kind == "UPDATE") & where & _has(sql, "CASE") & _has(sql, "WHEN"), "BATCH_UPDATE"),
        (kind == "INSERT", "INSERT_AFFECTS"), ((kind == "INSERT") & _batch(sql), "BATCH_INSERT"),
        ((kind == "SELECT") & ~where & ~_has(sql, "LIMIT"), "SELECT_UNBOUNDED"), (dynamic, "DYNAMIC_SQL"),
    ]
    return F.array_compact(F.array(*[F.when(test, code) for test, code in rules]))


@dataclass(frozen=True)
class Rule:
    """A performance rule; test maps (sql, kind) to a boolean column. Add one to RULES to extend the engine."""

    name: str
    severity: str
    test: object


RULES = [
    Rule("FULL_TABLE_SCAN", "HIGH", lambda sql, kind: (kind == "SELECT") & ~_has(sql, "WHERE") & ~_has(sql, "LIMIT")),
    Rule("SELECT_STAR", "MEDIUM", lambda sql, kind: sql.rlike("(?i)SELECT\\s+\\*")),
    Rule("LIKE_WILDCARD", "HIGH", lambda sql, kind: sql.rlike("(?i)LIKE\\s+'%")),
    Rule("NESTED_SUBQUERY", "MEDIUM", lambda sql, kind: F.regexp_count(F.upper(sql), F.lit("SELECT")) > 1),
    Rule("OR_CONDITION", "LOW", lambda sql, kind: F.regexp_count(F.upper(sql), F.lit(" OR ")) >= 3),
]


def issues(sql: Column, kind: Column, rules: list[Rule] = RULES) -> Column:
    """Array of (name, severity) of the rules that hold."""
    return F.array_compact(F.array(*[F.when(r.test(sql, kind), F.struct(F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))) for r in rules]))


def score(found: Column) -> Column:
    """100 less the penalties, at least 0."""
    lost = F.aggregate(found, F.lit(0), lambda s, i: s + F.when(i["severity"] == "HIGH", PENALTIES["HIGH"]).when(i["severity"] == "MEDIUM", PENALTIES["MEDIUM"]).otherwise(PENALTIES["LOW"]))
    return F.greatest(F.lit(0), 100 - lost)


def level(points: Column) -> Column:
    out = F.lit("POOR")
    for least, name in reversed(LEVELS):
        out = F.when(points >= least, name).otherwise(out)
    return out


def fields(sql: Column, kind: Column, compat: bool = False) -> Column:
    """Columns that a statement reads (SELECT) or writes (INSERT, UPDATE); DELETE has none.

    Functions and * give none. With compat, a qualified t.col counts as t.
    """
    bare = lambda c: F.regexp_replace(F.trim(c), "^[`\"']+|[`\"']+$", "")
    selected = F.transform(
        F.filter(F.split(F.trim(F.regexp_extract(sql, "(?is)SELECT\\s+(.*?)\\s+FROM", 1)), ","), lambda c: (F.trim(c) != "") & (F.trim(c) != "*") & ~c.contains("(")),
        lambda c: F.regexp_extract(F.trim(c), "^(\\w+)" if compat else "^(?:\\w+\\.)?(\\w+)", 1),
    )
    inserted = F.transform(F.split(F.regexp_extract(sql, "(?i)INSERT\\s+INTO\\s+\\w+\\s*\\((.*?)\\)", 1), ","), bare)
    clause = F.regexp_extract(F.concat(sql, F.lit(" WHERE ")), "(?is)UPDATE\\s+\\w+\\s+SET\\s+(.*?)\\s+WHERE", 1)
    updated = F.transform(F.filter(F.split(clause, ","), lambda a: a.contains("=")), lambda a: bare(F.split(a, "=")[0]))
    found = F.when(kind == "SELECT", selected).when(kind == "INSERT", inserted).when(kind == "UPDATE", updated).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda c: c != "")


def source_kind(method: Column) -> Column:
    m = F.lower(method)
    return F.when(m.contains("controller"), "USER_INPUT").when(m.contains("config"), "CONFIG").otherwise("OTHER_TABLE")


def consumer_kind(method: Column) -> Column:
    m = F.lower(method)
    return (
        F.when(m.contains("controller") | m.contains("api"), "API").when(m.contains("report") | m.contains("export"), "REPORT")
        .when(m.contains("service"), "SERVICE").otherwise("OTHER_SQL")
    )


def attribute(line: Column, name: str) -> Column:
    """The first value in quotes, of word characters only, behind a name and an equals sign; null without one. The name may
    end a longer one."""
    return F.nullif(F.regexp_extract(line, name + r"\s*=\s*['\"](\w+)['\"]", 1), F.lit(""))
