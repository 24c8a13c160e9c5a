"""Sorted key-value tables: point lookup and scan from a lower bound.

Keys are compared byte by byte.  A null key cannot be looked up and is refused when a table is built; null values are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.errors import FormatError

MANIFEST = "manifest"


class DuplicateKeyError(ValueError):
    pass


class SortedTable:
    """Rows (key, value) with unique keys."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> SortedTable:
        """Write a new table, ranged and sorted by key, so that lookups prune by file statistics.

        The stored rows are checked for repeated keys, range by range, before the table can be opened.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        if files.exists(spark, path):
            raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path}")
        key = F.when(F.col("key").isNull(), F.raise_error(F.lit("a key must not be null"))).otherwise(F.col("key"))
        rows.select(key.alias("key"), "value").repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/rows")
        stored = spark.read.schema(rows.select("key", "value").schema).parquet(f"{path}/rows")
        if not stored.groupBy("key").count().where("count > 1").isEmpty():
            files.delete(spark, path)
            raise DuplicateKeyError("keys must be unique")
        files.commit_manifest(spark, f"{path}/{MANIFEST}", 1, {"format": 1, "schema": stored.schema.json()})
        return cls(stored)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SortedTable:
        found = files.read_manifest(spark, f"{path.rstrip('/')}/{MANIFEST}")
        if found is None:
            raise FormatError(f"not a sorted table: {path}")
        from pyspark.sql.types import StructType
        import json

        return cls(spark.read.schema(StructType.fromJson(json.loads(found[1]["schema"]))).parquet(f"{path.rstrip('/')}/rows"))

    def get(self, key):
        """The value, or None."""
        row = self.lookup(key).first()
        return None if row is None else row["value"]

    def lookup(self, key) -> DataFrame:
        return self.rows.where(F.col("key") == F.lit(key))

    def find(self, key=None) -> DataFrame:
        """All rows from the first key that is not below ``key``, in order."""
        rows = self.rows if key is None else self.rows.where(F.col("key") >= F.lit(key))
        return rows.orderBy("key")
