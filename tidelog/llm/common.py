"""Shared helpers: tables in the shared folder, sizes, temporary column names."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_SIZE = 1 << 50
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session where the setting is absent, as in tests, uses a folder of this machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/tidelog/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`; no error when it is gone."""
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted when each query ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table survives the loss of any executor.  Shuffle files of the query
    that produced it are dropped at once, so disk use does not add up over phases.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing lazy reads any more."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand texts to Python workers in batches of at most ``size``, in the JVM and in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(function):
    """A batch function whose worker gives its free memory back when a task ends, since workers are reused by later stages."""

    def run(stream):
        yield from function(stream)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


class Shared:
    """A small value for all workers, broadcast with its class, which a plain broadcast would look up in an installed copy."""

    def __init__(self, spark: SparkSession, value):
        self.box = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        return pickle.loads(self.box.value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, side: DataFrame, key: str, n: str, spread, part: int = 1_000_000, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``side``, which has one row of each key and in ``n`` how many rows have it.

    A key of more than ``part`` rows meets a copy of its one row for each ``part`` of them, dealt by the long column ``spread``; there are
    at most as many such keys as rows over ``part``, and they alone are broadcast.
    """
    hot = side.where(F.col(n) > part).select(key, F.ceil(F.col(n) / part).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(side.drop(n), key, how)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / part).cast("int"), F.lit(1)) - 1))).drop(n)
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def scaled(df: DataFrame, each: int = 16 << 20) -> int:
    """Partitions for a shuffle of about as many bytes as ``df`` has by the planner's estimate, ``each`` bytes at most; twice the session's number at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN_SIZE:
        size = 0  # the planner does not know
    return max(2 * partitions(df.sparkSession), -(-size // each))


def sieve(hashes: DataFrame, most: int = 26):
    """A filter for a column of uniform 64-bit hashes: keeps every row whose hash is in the one column of ``hashes``, and few others.

    A map of 16 to 32 bits a hash, so that a join after it shuffles little else; 2 ** ``most`` bits at most, more hashes let more others pass.
    """
    (name,) = hashes.columns
    bits = min(most, max(16, (16 * hashes.count()).bit_length()))
    place = hashes.select(F.shiftrightunsigned(name, 64 - bits).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("word"))
    with released_shuffles(hashes.sparkSession):
        words = words.toArrow()
    flat = np.zeros(1 << bits - 6, np.int64)
    flat[words["at"].to_numpy()] = words["word"].to_numpy()
    shared = Shared(hashes.sparkSession, flat)

    @F.arrow_udf("boolean")
    def may_be(values: pa.Array) -> pa.Array:
        at = values.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array(shared.load().view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1)

    return may_be


def text_column(df: DataFrame, text: str):
    return F.col(f"`{text}`").cast("string")


def long_column(df: DataFrame, name: str):
    return F.col(f"`{name}`").cast("bigint")


def crc_mod(doc_id, n: int):
    """crc32 of the id written as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names built from ``names`` that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))
