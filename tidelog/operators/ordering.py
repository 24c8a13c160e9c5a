"""Scan order, positions, early stop and chains.

A window over a whole partition key would put a key that holds a third of all rows into
one task.  Positions are therefore computed from counts: of blocks of the ordering column inside a key, of
blocks of the sequence inside one value of the ordering column, and of the rows inside those.

Nulls: a null ``ts`` or ``seq`` is below every other, so that in scan order (newest first, ties in
insertion order) rows without ``ts`` come last and among ties rows without ``seq`` first; null keys
are a key of their own.  Rows equal in keys, ``ts`` and ``seq`` get different positions in any order.
Columns of the caller are kept, but for one named as the result, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the ordering column that one block covers.
WIDTH = 1 << 16
#: The block of nulls.
NONE = -(2**63)


def scan_order(ascending: bool = False) -> list[Column]:
    """Newest first, ties in insertion order; or the exact reverse."""
    return [F.asc("ts"), F.desc("seq")] if ascending else [F.desc("ts"), F.asc("seq")]


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names built from ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def block_of(value: Column, width: int) -> Column:
    return F.coalesce(F.floor(value / width).cast("bigint"), F.lit(NONE))


def attach(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``side``; null keys meet null keys."""
    renamed = [f"_side_{i}" for i in range(len(keys))]
    renamed = spare(rows, *renamed)
    other = side.select(*[col(k).alias(r) for k, r in zip(keys, renamed, strict=True)], *[col(c) for c in side.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [rows[f"`{k}`"].eqNullSafe(other[f"`{r}`"]) for k, r in zip(keys, renamed, strict=True)])
    return rows.join(other, on, how).drop(*renamed)


def directed(name: str, descending: bool) -> Column:
    return F.desc(f"`{name}`") if descending else F.asc(f"`{name}`")


def positions(df: DataFrame, keys: list[str], by: str, order: list[Column], descending: bool, width: int = WIDTH, ties: str | None = None, name: str = "pos") -> DataFrame:
    """``name``: the 1-based place of each row among those with its ``keys``.

    ``order`` must begin with the long column ``by``, followed by ``ties`` in the other direction where
    that is given; then also the rows of one value of ``by`` may be any number.
    """
    block, tie, n, before, inner = spare(df, "block", "tie_block", "n", "before", "inner")
    blocks = df.drop(name).withColumn(block, block_of(col(by), width))
    earlier = (Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(*map(col, keys), col(block))
    if ties is None:
        cells = sizes.agg(F.count("*").alias(n))
        starts = cells.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(*map(col, keys)).orderBy(directed(block, descending)).rowsBetween(*earlier)), F.lit(0))).drop(n)
        where = [*keys, block]
    else:
        blocks = blocks.withColumn(tie, block_of(col(ties), width))
        cells = blocks.groupBy(*map(col, [*keys, block, by, tie])).agg(F.count("*").alias(n))
        way = [directed(by, descending), directed(tie, not descending)]
        cells = cells.withColumn(inner, F.coalesce(F.sum(n).over(Window.partitionBy(*map(col, [*keys, block])).orderBy(*way).rowsBetween(*earlier)), F.lit(0)))
        tops = sizes.agg(F.count("*").alias(n))
        tops = tops.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(*map(col, keys)).orderBy(directed(block, descending)).rowsBetween(*earlier)), F.lit(0))).drop(n)
        starts = attach(cells.drop(n), tops, [*keys, block]).withColumn(before, col(before) + col(inner)).drop(inner)
        where = [*keys, block, by, tie]
    inside = F.row_number().over(Window.partitionBy(*map(col, where)).orderBy(*order))
    return attach(blocks, starts, where).withColumn(name, (col(before) + inside).cast("bigint")).drop(block, tie, before)


def scan_positions(df: DataFrame, keys: list[str], ascending: bool = False, width: int = WIDTH, name: str = "pos") -> DataFrame:
    return positions(df, keys, "ts", scan_order(ascending), not ascending, width, "seq", name)


def previous(df: DataFrame, keys: list[str], seq: str = "seq", width: int = WIDTH, name: str = "prev") -> DataFrame:
    """``name``: the ``seq`` of the row before with the same keys in order of ``seq``, 0 if there is none.

    A row without ``seq`` has none before it and comes before no other.
    """
    block, top, older = spare(df, "block", "top", "older")
    blocks = df.drop(name).withColumn(block, block_of(col(seq), width))
    tops = blocks.groupBy(*map(col, [*keys, block])).agg(F.max(col(seq)).alias(top))
    chain = tops.withColumn(older, F.lag(top).over(Window.partitionBy(*map(col, keys)).orderBy(col(block)))).drop(top)
    inside = F.lag(col(seq)).over(Window.partitionBy(*map(col, [*keys, block])).orderBy(col(seq)))
    return attach(blocks, chain, [*keys, block]).withColumn(name, F.coalesce(inside, col(older), F.lit(0)).cast("bigint")).drop(block, older)


def scan_rank(ascending: bool) -> Column:
    """A struct that sorts rows in scan order; ``~x`` turns the order of longs without overflow."""

    def part(name: str, down: bool) -> list[Column]:
        value = col(name)
        return [value.isNull() if down else value.isNotNull(), F.bitwise_not(value) if down else value]

    cells = part("ts", not ascending) + part("seq", ascending)
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])


def take_while(df: DataFrame, keys: list[str], stop: Column, ascending: bool = False, name: str = "pos") -> DataFrame:
    """Rows in scan order up to the first for which ``stop`` holds, that one (with its equals in ``ts`` and ``seq``) included.

    The first stop of each key is one aggregated row; positions are computed only for the rows that stay.
    """
    rank, limit = spare(df, "rank", "limit")
    ranked = df.withColumn(rank, scan_rank(ascending))
    stops = ranked.where(stop).groupBy(*map(col, keys)).agg(F.min(col(rank)).alias(limit))
    kept = attach(ranked, stops, keys, "left").where(col(limit).isNull() | (col(rank) <= col(limit))).drop(rank, limit)
    return scan_positions(kept, keys, ascending, name=name)


def until_empty(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in scan order before the first empty payload, as a store that ends lists with one would read them; null payloads stay."""
    return take_while(df, keys, F.col("data") == "").where("data is null or data <> ''")


def top_k(df: DataFrame, keys: list[str], k: int, ascending: bool = False, name: str = "pos") -> DataFrame:
    """The first ``k`` rows of each key in scan order; partial limits run before the shuffle."""
    w = Window.partitionBy(*map(col, keys)).orderBy(*scan_order(ascending))
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(col(name) <= k)
