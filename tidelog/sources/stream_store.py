"""Append-only logs on disk.

Every append is a directory of its own with the events, the postings (every entry with its link to the older
event on the same key, clustered by key) and the tails that it moved.  Versioned manifests name the appends:
a torn or failed append is in none, so that it is never read; of two appends at a time one is refused.
Reopening a log reads the manifest alone.

Nulls: an event without indexes is on no index; null payloads are kept.  Rows to append with a null ``seq`` are
refused; with ``order``, null order values come first.  Other columns of what is appended are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import bucket_of
from ..operators import streams
from . import files
from .errors import LOG_SEALED, FormatError, ImmutableError

LOG = "stream string, seq long, data string, indexes map<string,string>"
POSTINGS = "stream string, index_key string, seq long, prev long, data string, indexes map<string,string>, bucket int"
TAILS = "stream string, index_key string, tail long"
MANIFEST = "manifest"
#: Tables of tails that are folded into one when there are more.
FOLD = 8


def numbered(spark: SparkSession, events: DataFrame, order: list[str], path: str) -> DataFrame:
    """``seq`` from 1 in the order of columns: ranges are written sorted, counted, and numbered from the counts before them."""
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order)
    # the identifier is the partition's number and the place of the row in it
    ranged.select("data", "indexes", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    placed = spark.read.schema("data string, indexes map<string,string>, place long").parquet(path).withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select((F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("seq"), "data", "indexes")


def linked(rows: DataFrame, tails: DataFrame) -> DataFrame:
    """Entries of new events with ``prev``, the first of each key linked to its tail before."""
    inside = streams.links(rows)
    older = tails.select("stream", "index_key", F.col("tail").alias("_tail"))
    return inside.join(older, ["stream", "index_key"], "left").withColumn("prev", F.when(F.col("prev") > 0, F.col("prev")).otherwise(F.coalesce("_tail", F.lit(0)))).drop("_tail")


def newest(tails: DataFrame) -> DataFrame:
    return tails.groupBy("stream", "index_key").agg(F.max("tail").alias("tail"))


class StreamLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str = "stream", file_rows: int = files.FILE_ROWS) -> StreamLog:
        log = cls(spark, path)
        if files.exists(spark, path):
            raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path}")
        try:
            files.commit_manifest(spark, f"{log.path}/{MANIFEST}", 0, {"name": name, "appends": [], "tails": [], "offset": 0, "length": 0, "sealed": False, "file_rows": file_rows})
        except files.CommitConflict:
            raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path}") from None
        return log

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StreamLog:
        """A log that can be appended to, or one that cannot if it was sealed."""
        log = cls(spark, path)
        if not files.versions(spark, f"{log.path}/{MANIFEST}"):
            raise FormatError(f"not a log: {path}")
        return log

    def _latest(self) -> tuple[int, dict]:
        return files.read_manifest(self.spark, f"{self.path}/{MANIFEST}")

    @property
    def state(self) -> dict:
        return self._latest()[1]

    @property
    def closed(self) -> bool:
        return self.state["sealed"]

    @property
    def offset(self) -> int:
        """The sequence number of the newest event, 0 before the first."""
        return self.state["offset"]

    @property
    def length(self) -> int:
        """How many events there are."""
        return self.state["length"]

    def append(self, events: DataFrame, order: list[str] | None = None) -> int:
        """Append rows (data, indexes) in the order of ``order`` columns, or (seq, data, indexes) with seq from 1 on; returns how many.

        A failure leaves nothing behind that is ever read; the next append takes the same sequence numbers.
        """
        spark, (version, state) = self.spark, self._latest()
        if state["sealed"]:
            raise ImmutableError(LOG_SEALED)
        base, name = state["offset"], state["name"]
        own = f"append-{len(state['appends'])}-{uuid.uuid4().hex}"
        target, done = f"{self.path}/{own}", False
        try:
            with files.temporary(spark, f"{target}-ranges") as ranges:
                if order:
                    events = numbered(spark, events, order, ranges)
                seq = F.when(F.col("seq").isNull(), F.raise_error(F.lit("an event to append needs a seq"))).otherwise(F.col("seq"))
                rows = events.select(F.lit(name).alias("stream"), (seq + base).cast("bigint").alias("seq"), "data", "indexes")
                rows.write.parquet(f"{target}/events")
            stored = spark.read.schema(LOG).parquet(f"{target}/events")
            seen = stored.agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("top")).first()
            if seen["n"] and (seen["low"] != base + 1 or seen["top"] - base != seen["n"]):
                raise ValueError("sequence numbers of an append must be 1 to n")
            links = linked(stored, self.tails(state))
            fine = bucket_of(F.col("index_key"), files.MOST_BUCKETS)
            buckets, spread = files.layout(streams.entries(stored).select("index_key"), fine, state["file_rows"])
            postings = links.withColumn("bucket", bucket_of(F.col("index_key"), buckets)).select(*[c.split()[0] for c in POSTINGS.split(", ")])
            clustered = files.dealt(postings, spread, F.col("seq")).sortWithinPartitions("bucket", "index_key", F.desc("seq"))
            clustered.write.partitionBy("bucket").parquet(f"{target}/postings")
            streams.tails(stored).write.parquet(f"{target}/tails")
            tails = [*state["tails"], f"{own}/tails"]
            if len(tails) > FOLD:
                newest(self._read_tails(tails)).write.parquet(f"{target}/folded")
                tails = [f"{own}/folded"]
            top = base + seen["n"]
            files.commit_manifest(spark, f"{self.path}/{MANIFEST}", version + 1, {**state, "appends": [*state["appends"], {"name": own, "buckets": buckets if spread else 0}], "tails": tails, "offset": top, "length": state["length"] + seen["n"]})
            done = True
        finally:
            if not done:
                files.delete(spark, target)
        return seen["n"]

    def events(self) -> DataFrame:
        appends = self.state["appends"]
        if not appends:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{a['name']}/events" for a in appends])

    def postings(self, key: str | None = None) -> DataFrame:
        """stream, index_key, seq, prev, data, indexes of every entry, or of those on one key: one bucket of each append."""
        parts = []
        for a in self.state["appends"]:
            if a["buckets"]:
                rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{a['name']}/postings")
                if key is not None:
                    rows = rows.where((F.col("bucket") == bucket_of(F.lit(key), a["buckets"])) & (F.col("index_key") == F.lit(key)))
                parts.append(rows.drop("bucket"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], POSTINGS).drop("bucket")

    def _read_tails(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(TAILS).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], TAILS)

    def tails(self, state: dict | None = None) -> DataFrame:
        """The newest event of each index key, from the stored tables of tails."""
        names = (state or self.state)["tails"]
        rows = self._read_tails(names)
        return rows if len(names) < 2 else newest(rows)

    def first(self, name: str, value: str) -> int:
        """The newest event on an index key, 0 if there is none."""
        row = self._read_tails(self.state["tails"]).where(F.col("index_key") == f"{name}:{value}").agg(F.max("tail").alias("tail")).first()
        return row["tail"] or 0

    def iterate(self, cursor: int = 0, limit: int | None = None) -> DataFrame:
        return streams.iterate(self.events(), cursor, limit)

    def scan_index(self, name: str, value: str, cursor: int = 0, limit: int | None = None) -> DataFrame:
        """stream, seq, prev, data, indexes of the events on an index key, newest first; ``prev`` is the cursor that goes on, 0 at the end."""
        rows = self.postings(f"{name}:{value}").drop("index_key")
        rows = (rows.where(F.col("seq") <= cursor) if cursor > 0 else rows).orderBy(F.desc("seq"))
        return rows if limit is None else rows.limit(limit)

    def seal(self) -> None:
        """Fold the tails into one sorted table and refuse further appends; a second call does nothing."""
        version, state = self._latest()
        if not state["sealed"]:
            own = f"sealed-{uuid.uuid4().hex}"
            newest(self._read_tails(state["tails"])).repartitionByRange("index_key").sortWithinPartitions("index_key").write.parquet(f"{self.path}/{own}")
            files.commit_manifest(self.spark, f"{self.path}/{MANIFEST}", version + 1, {**state, "tails": [own], "sealed": True})

    close = seal

    def recover(self) -> list[str]:
        """Delete what torn appends left behind; returns the names.  Not to be called beside a running append."""
        state = self.state
        known = {MANIFEST, *[a["name"] for a in state["appends"]], *[t.split("/")[0] for t in state["tails"]]}
        torn = [n for n in files.names(self.spark, self.path) if n not in known and not n.startswith(".")]
        for n in torn:
            files.delete(self.spark, f"{self.path}/{n}")
        return torn


def merge(spark: SparkSession, target: str, paths: list[str]) -> StreamLog:
    """A new sealed log of all events of the given logs, one log after the other."""
    sources = [StreamLog.open(spark, p) for p in paths]
    out = StreamLog.create(spark, target)
    if sources:
        out.append(streams.merge([s.events() for s in sources], "stream"))
    out.seal()
    return out
