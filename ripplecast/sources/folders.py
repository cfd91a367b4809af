"""Files and folders as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are no part of a project's own sources.
SKIPPED = [".git/", "src/test"]


def matching(globs: list[str]) -> Column:
    """Whether the column path ends in any of the globs at a slash; * stands for any name, ** for any folders."""
    patterns = [g.replace(".", "\\.").replace("**/", "(?:.+/)?").replace("*", "[^/]*") for g in globs]
    rules = [f"/{p}$" if "/" not in g else f"/(?:{p})$" for g, p in zip(globs, patterns, strict=True)]
    return reduce(lambda a, b: a | b, [F.col("path").rlike(r) for r in rules], F.lit(False))


def project_files(spark: SparkSession, folder: str, pattern: str = "*", ignored: list[str] | None = None) -> DataFrame:
    """(path, length, content) of the files below folder whose names match, without skipped folders and ignored globs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    for part in SKIPPED:
        files = files.filter(~F.col("path").contains(part))
    return files.filter(~matching(ignored or [])).select("path", "length", "content")


def by_globs(spark: SparkSession, folder: str, globs: list[str]) -> DataFrame:
    """project_files whose path below folder matches any of the globs, each file once; ** stands for any folders."""
    return project_files(spark, folder).filter(matching(globs))


def catalogue(spark: SparkSession, folder: str, *levels: str) -> DataFrame:
    """The distinct values of partition folders below folder, as text, from the listing alone: no file is opened."""
    columns = ", ".join(["path string, modificationTime timestamp, length long, content binary", *[f"{level} string" for level in levels]])
    return spark.read.format("binaryFile").schema(columns).load(folder).select(*levels).distinct()
