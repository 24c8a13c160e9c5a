"""Immutable archives on disk: bucketed Parquet, covering postings and a manifest.

The number of buckets and of each bucket's files follow from the rows, so that a large archive is written by
many tasks and a space with a large share of all rows is not one of them; inside a file rows are in scan order.

Nulls: a null or empty space or payload is refused; a null grouping is a grouping of its own, a null ``ts`` is older
than every other; an event without indexes has no postings.  Other columns of what is added are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket_of
from ..operators.archive import ArchiveView, postings_of
from . import files
from .errors import DATABASE_WRITTEN, SPACE_WRITTEN, FormatError, ImmutableError

EVENTS = "space string, grouping string, ts long, seq long, data string, indexes map<string,string>, bucket int"
POSTINGS = "space string, index_key string, ts long, seq long, grouping string, data string, bucket int"
MANIFEST = "manifest"


class ArchiveWriter:
    """Collects events; ``flush`` stores one space early, ``write`` stores the rest and ends the archive."""

    def __init__(self, spark: SparkSession, path: str, file_rows: int = files.FILE_ROWS):
        if files.exists(spark, path):
            raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path}")
        self.spark, self.path, self.file_rows = spark, path.rstrip("/"), file_rows
        self.parts: list[DataFrame] = []
        self.sealed: list[str] = []
        self.written = False

    def add(self, events: DataFrame) -> None:
        """Rows space, grouping, ts, seq, data, indexes.  Rows of a flushed space fail here."""
        if self.written:
            raise ImmutableError(DATABASE_WRITTEN)
        if self.sealed and not events.where(F.col("space").isin(self.sealed)).isEmpty():
            raise ImmutableError(SPACE_WRITTEN)
        space = F.when(F.coalesce(F.col("space"), F.lit("")) == "", F.raise_error(F.lit("a space needs an id"))).otherwise(F.col("space"))
        data = F.when(F.coalesce(F.col("data"), F.lit("")) == "", F.raise_error(F.lit("an event needs data"))).otherwise(F.col("data"))
        self.parts.append(events.select(space.alias("space"), "grouping", F.col("ts").cast("bigint").alias("ts"), F.col("seq").cast("bigint").alias("seq"), data.alias("data"), "indexes"))

    def _store(self, events: DataFrame, name: str) -> dict:
        """One part of the archive: its name, and the buckets by which lookups prune."""
        fine = bucket_of(F.col("space"), files.MOST_BUCKETS)
        buckets, spread = files.layout(events, fine, self.file_rows)
        for kind, rows, order in (("events", events, ["space", "grouping"]), ("postings", postings_of(events), ["space", "index_key"])):
            bucketed = rows.withColumn("bucket", bucket_of(F.col("space"), buckets))
            out = files.dealt(bucketed, spread, F.col("seq")).sortWithinPartitions("bucket", *order, F.desc("ts"), "seq")
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/{kind}")
        return {"name": name, "buckets": buckets}

    def _pending(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None

    def flush(self, space: str) -> None:
        """Store a space now; an unknown one is nothing to do."""
        pending = self._pending()
        if pending is None or space in self.sealed:
            return
        mine = pending.where(F.col("space") == space)
        if not mine.isEmpty():
            self.sealed.append(space)
            self._store(mine, f"part-{len(self.sealed)}")
            self.parts = [p.where(F.col("space") != space) for p in self.parts]

    def write(self) -> None:
        if self.written:
            raise ImmutableError(DATABASE_WRITTEN)
        pending = self._pending()
        if pending is None:
            pending = self.spark.createDataFrame([], EVENTS).drop("bucket")
        flushed = [{"name": f"part-{k + 1}", "space": s} for k, s in enumerate(self.sealed)]
        rest = self._store(pending, "part-0")
        self.written = True
        # readers accept the archive only from here on
        files.commit_manifest(self.spark, f"{self.path}/{MANIFEST}", 1, {"format": 2, "parts": [rest, *flushed]})


class Archive(ArchiveView):
    """An archive that was written; its methods are those of :class:`ArchiveView`."""

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Archive:
        path = path.rstrip("/")
        found = files.read_manifest(spark, f"{path}/{MANIFEST}")
        if found is None:
            raise FormatError(f"not an archive: {path}")
        rest, *flushed = found[1]["parts"]
        archive = cls.__new__(cls)
        archive.closed, archive.rest = False, stored_view(spark, path, rest["name"], rest["buckets"])
        archive.flushed = {p["space"]: stored_view(spark, path, p["name"], None) for p in flushed}
        views = [archive.rest, *archive.flushed.values()]
        ArchiveView.__init__(archive, *[reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(v, kind) for v in views]) for kind in ("events", "postings")])
        return archive

    def space(self, id_):
        """A flushed space is a part of its own; any other is looked up in its bucket."""
        if self.closed:
            raise ValueError("the archive is closed")
        return self.flushed.get(id_, self.rest).space(id_)

    def close(self) -> None:
        """Further lookups fail; tables handed out before stay readable, since nothing is held open."""
        self.closed = True


def stored_view(spark: SparkSession, path: str, name: str, buckets: int | None) -> ArchiveView:
    def table(kind: str, schema: str) -> DataFrame:
        if not any(n.startswith("bucket=") for n in files.names(spark, f"{path}/{name}/{kind}")):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{path}/{name}/{kind}")

    return ArchiveView(table("events", EVENTS), table("postings", POSTINGS), buckets)
