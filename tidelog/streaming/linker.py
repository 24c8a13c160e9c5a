"""Structured Streaming over logs: linking appended events and keeping tails.

Micro-batches must arrive in sequence order.  What a batch writes is named by its id, so a
replayed batch overwrites itself: links under ``links/batch=<id>``, the tails it moved under
``tails/batch=<id>``.  Every ``FOLD`` batches the tails up to there are folded into one table, so that a batch
writes its own keys only and reads a bounded number of tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import streams
from ..sources import files
from ..sources.stream_store import TAILS, linked, newest

LINKS = "stream string, seq long, index_key string, prev long, batch long"
FOLD = 16


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A streaming read of a directory of log files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tails_before(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """The tails that batches below ``batch_id`` left: the newest folded table and the batches since."""
    folded = batch_id // FOLD * FOLD
    paths = [f"{target}/folded/{folded}"] if folded else []
    paths += [f"{target}/tails/batch={k}" for k in range(folded, batch_id)]
    paths = [p for p in paths if files.exists(spark, p)]
    return newest(spark.read.schema(TAILS).parquet(*paths)) if paths else spark.createDataFrame([], TAILS)


def keep_tails(spark: SparkSession, target: str, batch_id: int, moved: DataFrame) -> None:
    moved.write.mode("overwrite").parquet(f"{target}/tails/batch={batch_id}")
    if (batch_id + 1) % FOLD == 0:  # the tables it replaces stay for a replay of this batch
        own = spark.read.schema(TAILS).parquet(f"{target}/tails/batch={batch_id}")
        newest(tails_before(spark, target, batch_id).unionByName(own)).write.mode("overwrite").parquet(f"{target}/folded/{batch_id + 1}")
        old = batch_id + 1 - 2 * FOLD
        if old >= 0:
            for k in range(old, old + FOLD):
                files.delete(spark, f"{target}/tails/batch={k}")
            files.delete(spark, f"{target}/folded/{old}")


def link_batches(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Link each batch to the tails before it; runs to the current end of the source."""
    spark = log.sparkSession

    def link(batch: DataFrame, batch_id: int) -> None:
        rows = linked(batch, tails_before(spark, target, batch_id))
        rows.select("stream", "seq", "index_key", "prev").write.mode("overwrite").parquet(f"{target}/links/batch={batch_id}")
        keep_tails(spark, target, batch_id, streams.tails(batch))

    return log.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def links(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(LINKS).parquet(f"{target}/links").drop("batch")


def tails_query(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Tails kept in the query's state; each batch writes those it moved below ``target``."""
    spark = log.sparkSession
    return streams.tails(log).writeStream.outputMode("update").foreachBatch(lambda moved, k: keep_tails(spark, target, k, moved)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tails(spark: SparkSession, target: str) -> DataFrame:
    """The tails that the batches so far left below ``target``."""
    done = [int(n.split("=")[1]) for n in files.names(spark, f"{target}/tails") if n.startswith("batch=")]
    return tails_before(spark, target, max(done, default=-1) + 1)
