"""Stream queries over a DataFrame of log events (stream, seq, data, indexes); seq starts at 1.

Nulls: an event without indexes, or with a null value of one, is not on that index; an event without ``seq`` is
delivered first from the start and never from a cursor, and is linked to nothing.  Other columns are kept by
``entries``, ``links``, ``iterate`` and ``scan_index``; empty logs give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import index_key, index_keys
from . import ordering


def entries(log: DataFrame) -> DataFrame:
    """One row per event and index key; a key that an event carries twice is one entry."""
    return log.withColumn("index_key", F.explode(F.array_distinct(index_keys(F.col("indexes")))))


def tails(log: DataFrame) -> DataFrame:
    """The newest event of each index key."""
    return entries(log).groupBy("stream", "index_key").agg(F.max("seq").alias("tail"))


def links(log: DataFrame) -> DataFrame:
    """``prev`` of every entry: the older event on the same key, 0 if there is none."""
    return ordering.previous(entries(log), ["stream", "index_key"])


def iterate(log: DataFrame, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """Events in append order from a cursor; 0 or less is the start."""
    rows = log.where(F.col("seq") >= cursor) if cursor > 0 else log
    rows = rows.orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def next_cursor(delivered: DataFrame, cursor: int) -> DataFrame:
    """One row: the cursor after the delivered events, unchanged if there were none."""
    return delivered.agg(F.coalesce(F.max("seq") + 1, F.lit(max(cursor, 1)).cast("bigint")).alias("cursor"))


def scan_index(log: DataFrame, name: str, value: str, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """Events on an index key, newest first, from a cursor; 0 or less is the newest."""
    rows = log.where(F.exists(index_keys(F.col("indexes")), lambda k: k == index_key(name, value)))
    rows = (rows.where(F.col("seq") <= cursor) if cursor > 0 else rows).orderBy(F.desc("seq"))
    return rows if limit is None else rows.limit(limit)


def merge(logs: list[DataFrame], name: str) -> DataFrame:
    """All events of the first log, then of the second, and so on, as one log.

    Sequence numbers within a log must be 1 to n; the next log's follow on, so nothing is sorted.
    """
    tops = [log.agg(F.lit(k).alias("source"), F.coalesce(F.max("seq"), F.lit(0)).alias("n")) for k, log in enumerate(logs)]
    sizes = dict(map(tuple, reduce(DataFrame.unionByName, tops).collect()))  # one number a log
    parts, base = [], 0
    for k, log in enumerate(logs):
        parts.append(log.select(F.lit(name).alias("stream"), (F.col("seq") + base).cast("bigint").alias("seq"), "data", "indexes"))
        base += sizes[k]
    return reduce(DataFrame.unionByName, parts)
