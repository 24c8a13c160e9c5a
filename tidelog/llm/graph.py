"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs, any direction -> (node, root), root the smallest node of its component.

    Large-star and small-star steps alternate until the edges are stars around
    the roots.  Every round is a few aggregations and joins on node ids,
    written to the shared folder; nothing but two numbers reaches the driver.
    A root has no row for itself; neither has a node without links.  A pair with a null is no link; repeated pairs count once;
    an empty list has no rows.  Labels that still change after ``rounds`` are an error, never a result.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.materialize(now, "edges")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done = now
        now = common.materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        common.discard(done, large)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
