"""A table in a shared folder whose versions stand beside each other.

Rows lie in buckets by the hash of their keys. A change reads and writes only the buckets that it
touches, into a folder of its own, and then writes a manifest, one small file with the folders
that make up the new version. Spark moves that file into place when its job is done, so that a
version is there as a whole or not at all: a run that fails before leaves the last version as it
was, and its folder is read by nobody. Earlier versions stay readable. One writer at a time.

What reaches the driver is bounded by the number of buckets, never by rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, FOLDER = "bucket_of_row", "written_as"
BUCKETS = 16
#: Tasks that share one bucket's rows when they are written, so that a hot key is not one task's work.
SPREAD = 4


class VersionedTable:
    """The table below path, with rows in buckets by keys. Null keys are equal to each other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def versions(self) -> list[int]:
        """The numbers of all whole versions, from the listing of manifests."""
        try:
            found = self.spark.read.format("binaryFile").load(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(int(r["version"]) for r in found.select("version").distinct().collect()) if "version" in found.columns else []

    def _manifest(self, version: int) -> tuple[T.StructType, list[tuple[int, str]]]:
        row = self.spark.read.schema("columns string, parts array<struct<bucket:int,folder:string>>").json(f"{self.path}/manifest/version={version}").first()
        return T.StructType.fromJson(json.loads(row["columns"])), [(p["bucket"], p["folder"]) for p in row["parts"]]

    def _latest(self) -> tuple[int, T.StructType | None, list[tuple[int, str]]]:
        have = self.versions()
        return (have[-1], *self._manifest(have[-1])) if have else (0, None, [])

    def _rows(self, columns: T.StructType, parts: list[tuple[int, str]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], columns)
        full = T.StructType([*columns.fields, T.StructField(FOLDER, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        paths = [f"{self.path}/data/{FOLDER}={folder}/{BUCKET}={bucket}" for bucket, folder in parts]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).select(*columns.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named; only its own folders are listed and read."""
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise ValueError(f"no version {version if have else ''} at {self.path}")
        return self._rows(*self._manifest(have[-1] if version is None else version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The last version's rows of keys; only the buckets that can hold them are listed and read."""
        _, columns, parts = self._latest()
        if columns is None:
            raise ValueError(f"no table at {self.path}")
        touched, asked = self._touched(keys), keys.select(*self.keys).distinct()
        rows = self._rows(columns, [p for p in parts if p[0] in touched])
        return rows.join(asked, self._match(rows, asked), "left_semi")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def _write(self, rows: DataFrame) -> list[tuple[int, str]]:
        folder = uuid.uuid4().hex
        place = f"{self.path}/data/{FOLDER}={folder}"
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SPREAD))
        rows.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET), spread).write.partitionBy(BUCKET).parquet(place)
        found = self.spark.read.format("binaryFile").load(place)
        return [(int(r[0]), folder) for r in found.select(BUCKET).distinct().collect()] if BUCKET in found.columns else []

    def _commit(self, version: int, columns: T.StructType, parts: list[tuple[int, str]]) -> int:
        row = self.spark.createDataFrame([(columns.json(), sorted(parts))], "columns string, parts array<struct<bucket:int,folder:string>>")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")
        return version

    def _exchange(self, touched: set[int], change) -> int:
        """A new version in which the touched buckets hold change(their rows)."""
        version, columns, parts = self._latest()
        if columns is None:
            raise ValueError(f"no table at {self.path}")
        kept, old = [p for p in parts if p[0] not in touched], [p for p in parts if p[0] in touched]
        return self._commit(version + 1, columns, kept + self._write(change(self._rows(columns, old)).select(*columns.names)))

    def _match(self, old: DataFrame, keys: DataFrame) -> Column:
        same = F.lit(True)
        for k in self.keys:
            same = same & old[k].eqNullSafe(keys[k])
        return same

    def append(self, rows: DataFrame) -> int:
        """Rows beside those that are there; no old row is read. The first append makes the table."""
        version, columns, parts = self._latest()
        columns = columns or T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        return self._commit(version + 1, columns, parts + self._write(rows.select(*columns.names)))

    def replace(self, rows: DataFrame) -> int:
        """Deletes all rows of the keys that rows hold, then inserts rows."""
        keys = rows.select(*self.keys).distinct()
        return self._exchange(self._touched(rows), lambda old: old.join(keys, self._match(old, keys), "left_anti").unionByName(rows))

    def insert_absent(self, rows: DataFrame) -> int:
        """Inserts the rows whose keys are not there yet, whole groups of rows of one new key included."""
        _, columns, parts = self._latest()
        if columns is None:
            return self.append(rows)
        touched = self._touched(rows)
        have = self._rows(columns, [p for p in parts if p[0] in touched]).select(*self.keys).distinct()
        return self.append(rows.join(have, self._match(rows, have), "left_anti"))

    def delete(self, keys: DataFrame) -> int:
        """Deletes all rows of keys."""
        return self._exchange(self._touched(keys), lambda old: old.join(keys, self._match(old, keys), "left_anti"))

    def update(self, where: str, values: dict[str, Column]) -> int:
        """Sets values, which must not be keys, in the rows for which where is true."""
        if set(values) & set(self.keys):
            raise ValueError("keys do not change in place: delete and append")
        touched = self._touched(self.read().filter(where))
        changed = {c: F.when(F.expr(where), v).otherwise(F.col(c)) for c, v in values.items()}
        return self._exchange(touched, lambda old: old.withColumns(changed))
