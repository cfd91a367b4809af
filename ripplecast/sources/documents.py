"""Result documents: compact JSON, gzip files, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def compact(fields: dict[str, Column]) -> Column:
    """A JSON object without null fields; callers null out defaults."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


def expanded(doc: Column, schema: str, defaults: dict[str, object]) -> Column:
    """The object read back, missing fields at their defaults."""
    read = F.from_json(doc, schema)
    for name, value in defaults.items():
        read = read.withField(name, F.coalesce(read[name], F.lit(value)))
    return read


def write_documents(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Gzip JSON lines, in folders by partition columns, so that one chain is one folder."""
    writer = rows.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_documents(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items() if n in rows.columns})


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines below path; no rows where there is no such path."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def report_line(depth: Column, name: Column, change: Column) -> Column:
    return F.concat(F.repeat(F.lit("\t"), depth), name, F.lit(" ("), change, F.lit(")"))


def box(text: Column, width: int) -> Column:
    return F.concat(F.lit("| "), F.rpad(F.left(text, F.lit(width)), width, " "), F.lit(" |"))


def report(nodes: DataFrame) -> DataFrame:
    """One text a root from chain nodes (root_id, path, depth, name, change_type), in pre-order."""
    line = report_line(F.col("depth"), F.col("name"), F.col("change_type"))
    lines = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return nodes.groupBy("root_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))
