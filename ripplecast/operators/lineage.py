"""Field lineage: which statements read and write which table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S

# What names a data access class, and what is part of its package.
DAO_CLASSES = "(Mapper|Dao|Repository)$"
DAO_PACKAGES = [".mapper.", ".dao."]


def dao_methods(methods: DataFrame, classes: DataFrame, statements: DataFrame) -> DataFrame:
    """(method_id, is_dao): by class suffix, by package part, or linked to a statement."""
    linked = statements.filter("linked_method_id is not null").select(F.col("linked_method_id").alias("method_id"), F.lit(True).alias("linked")).distinct()
    full_name = F.concat_ws(".", "package_name", "class_name")
    named = F.col("class_name").rlike(DAO_CLASSES)
    for part in DAO_PACKAGES:
        named = named | full_name.contains(part)
    rows = methods.join(classes.select("class_id", "class_name", "package_name"), "class_id").join(linked, "method_id", "left")
    return rows.select("method_id", (named | F.coalesce("linked", F.lit(False))).alias("is_dao"))


def field_edges(statements: DataFrame, classes: DataFrame) -> DataFrame:
    """(stmt_id, table_name, field, op, mapper_method); fields go to a statement's first table by name."""
    sql, kind = F.col("sql_content"), F.col("sql_type")
    rows = statements.select("stmt_id", "class_id", "method_id", F.try_element_at(S.tables(sql), F.lit(1)).alias("table_name"), F.explode(S.fields(sql, kind)).alias("field"), F.when(kind == "SELECT", "READ").otherwise("WRITE").alias("op"))
    return rows.join(classes.select("class_id", "class_name"), "class_id").select("stmt_id", "table_name", "field", "op", F.concat_ws(".", F.lower("class_name"), "method_id").alias("mapper_method"))


def reads_writes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("table_name", "field").agg(F.count_if(F.col("op") == "READ").alias("reads"), F.count_if(F.col("op") == "WRITE").alias("writes"))


def impact(edges: DataFrame) -> DataFrame:
    """Consumers of each field by kind, their number, and a risk level."""
    kind = S.consumer_kind(F.col("mapper_method"))
    rows = edges.filter("op = 'READ'").groupBy("table_name", "field").agg(F.count_if(kind == "API").alias("api"), F.count_if(kind == "SERVICE").alias("service"), F.count_if(kind == "OTHER_SQL").alias("other"), F.count("*").alias("total"))
    return rows.withColumn("risk", F.when(F.col("total") > 10, "HIGH").when(F.col("total") > 5, "MEDIUM").otherwise("LOW"))


def statistics(fields: DataFrame) -> DataFrame:
    return fields.agg(
        F.count("*").alias("fields"), F.count_if(F.col("writes") > 0).alias("with_sources"), F.count_if(F.col("reads") > 0).alias("with_consumers"),
        F.round(100.0 * F.count_if(F.col("writes") > 0) / F.count("*"), 2).alias("percent_with_sources"),
    )
