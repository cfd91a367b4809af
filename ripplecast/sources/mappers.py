"""Mapper XML files as statement rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENTS = {"select", "insert", "update", "delete"}
#: Elements whose keyword belongs to the statement's text.
KEYWORDS = {"where": "WHERE", "set": "SET"}
SCHEMA = "path string, namespace string, method_id string, full_method string, sql_type string, parameter_type string, result_type string, sql_content string, is_dynamic_sql boolean"


def read_mappers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of each mapper file in folder and below, once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(folder)
    named = F.col("path").rlike("(?i)(mapper|dao)[^/]*\\.xml$") | F.col("path").rlike("(?i)/mappers?/")
    return files.filter(named).select("path", F.decode("content", "UTF-8").alias("text")).dropDuplicates(["path"])


def statement_text(node: ET.Element, fragments: dict[str, ET.Element], seen: frozenset[str] = frozenset()) -> str:
    """Text in document order; includes expanded (each at most once on a path), loops marked."""
    parts = [node.text or ""]
    for child in node:
        if child.tag == "include":
            ref = (child.get("refid") or "").rpartition(".")[2]
            parts.append(statement_text(fragments[ref], fragments, seen | {ref}) if ref in fragments and ref not in seen else f"/* {ref} */")
        elif child.tag == "foreach":
            parts.append(f" FOREACH {statement_text(child, fragments, seen)} ")
        elif child.tag != "selectKey":
            parts.append(f" {KEYWORDS.get(child.tag, '')} {statement_text(child, fragments, seen)} ")
        parts.append(child.tail or "")
    return "".join(parts)


def statements(files: DataFrame) -> DataFrame:
    """A row for each statement of (path, text); broken XML and files without a namespace give none."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    root = ET.fromstring(text)
                except (ET.ParseError, TypeError):
                    continue
                namespace = root.get("namespace")
                if root.tag != "mapper" or not namespace:
                    continue
                fragments = {n.get("id"): n for n in root.iter("sql") if n.get("id")}
                for n in root:
                    if n.tag in STATEMENTS and n.get("id"):
                        sql = " ".join(statement_text(n, fragments).split())
                        out.append((path, namespace, n.get("id"), f"{namespace}.{n.get('id')}", n.tag.upper(), n.get("parameterType"), n.get("resultType") or n.get("resultMap"), sql, any(c.tag in ("if", "choose", "foreach", "where", "set", "trim") for c in n.iter())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "text").mapInPandas(parse, SCHEMA)
