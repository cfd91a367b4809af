"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by sessions on one machine that name no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the session's shared checkpoint folder and go on from the written rows.

    It cuts the lineage, so that a later loss of executors costs a read and not a
    recomputation, and it fixes row order and partitions for what is read twice.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; without one only a session on one machine goes on."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_CHECKPOINTS


def stored(df: DataFrame) -> DataFrame:
    """As materialize, for wide rows: df as a compressed Parquet table in the shared folder.

    Row numbers from monotonically_increasing_id hold for one scan only, since a scan's
    partitions follow the cores at hand; rows that are read again by number are stored first.
    """
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored writes within it; the rows must have been used by then."""
    token = _made.set(made := [])
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str | Column, buckets: int) -> Column:
    """crc32(doc_id as text) mod buckets; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % buckets


def ascii_words(text: str | None) -> list[bytes]:
    """The runs of other characters than space, tab, \\n, \\v, \\f and \\r, as UTF-8."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As ascii_words, with A-Z in lower case and all other characters as they are."""
    return text.encode().lower().split() if text else []
