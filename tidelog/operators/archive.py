"""Archive queries over a DataFrame of events (space, grouping, ts, seq, data, indexes).

All methods return lazy DataFrames; an unknown space, grouping or index gives an empty one.  ``None`` names the events
whose space or grouping is null; events without indexes are on no index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.keys import bucket_of, index_key, index_keys
from . import ordering


def same(name: str, value) -> Column:
    return F.col(name).isNull() if value is None else F.col(name) == F.lit(value)


def postings_of(events: DataFrame) -> DataFrame:
    """One covering row per index entry: an event that carries a key twice is listed twice."""
    return events.select("space", F.explode(index_keys(F.col("indexes"))).alias("index_key"), "ts", "seq", "grouping", "data")


class Space:
    """One space of an archive."""

    def __init__(self, id_, events: DataFrame, postings: DataFrame):
        self.id, self.events, self.postings = id_, events, postings

    def _ordered(self, rows: DataFrame, limit: int | None, ascending: bool) -> DataFrame:
        rows = rows.orderBy(*ordering.scan_order(ascending))
        return rows if limit is None else rows.limit(limit)

    def groupings(self) -> DataFrame:
        return self.events.select("grouping").distinct().orderBy("grouping")

    def index_names(self) -> DataFrame:
        """Extension: the index names in use."""
        return self.events.select(F.explode(F.map_keys("indexes")).alias("name")).distinct().orderBy("name")

    def scan(self, grouping: str, limit: int | None = None, ascending: bool = False) -> DataFrame:
        """Events of one grouping ('' is a grouping of its own), newest first."""
        return self._ordered(self.events.where(same("grouping", grouping)), limit, ascending)

    def scan_index(self, name: str, value: str, limit: int | None = None, ascending: bool = False) -> DataFrame:
        """Events with this index value in any grouping, newest first."""
        return self._ordered(self.postings.where(F.col("index_key") == index_key(name, value)), limit, ascending)

    def scan_while(self, grouping: str, stop: Column) -> DataFrame:
        """Scan up to the first event that fulfils ``stop``, which is included."""
        rows = self.events.where(same("grouping", grouping))
        return ordering.take_while(rows, ["space", "grouping"], stop).orderBy("pos")


class ArchiveView:
    """Events as an archive; ``buckets`` adds the directory predicate of stored ones."""

    def __init__(self, events: DataFrame, postings: DataFrame | None = None, buckets: int | None = None):
        self.events, self.buckets = events, buckets
        self.postings = postings_of(events) if postings is None else postings

    def spaces(self) -> DataFrame:
        return self.events.select("space").distinct().orderBy("space")

    def space(self, id_) -> Space:
        here = same("space", id_)
        if self.buckets:  # a constant: prunes directories
            here = here & (F.col("bucket") == bucket_of(F.lit(id_), self.buckets))
        return Space(id_, self.events.where(here), self.postings.where(here))


def foreach_event(scan: DataFrame, visit: Callable[[Row], bool]) -> None:
    """Call ``visit`` row by row until it returns false; that row has been delivered."""
    rows: Iterator[Row] = scan.toLocalIterator()
    for row in rows:
        if not visit(row):
            break
