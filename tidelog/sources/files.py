"""Small files beside the tables, through Spark's file systems, so that any path Spark reads works."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has committed first."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _fs(spark, path)
    fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a directory, sorted; nothing if there is none."""
    target, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def create_bytes(spark: SparkSession, path: str, value: bytes) -> None:
    """A new file with all of its bytes; of several writers of one path one wins, the others get :class:`CommitConflict`.

    The bytes are written beside and renamed without overwriting, in one step where the file system can.
    """
    jvm = spark._jvm
    target, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(value))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise CommitConflict(path) from None
        raise


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, path) if n.endswith(".json"))


def read_manifest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The newest version below ``path`` and its number."""
    known = versions(spark, path)
    return (known[-1], json.loads(read_bytes(spark, f"{path}/{known[-1]:012d}.json"))) if known else None


def commit_manifest(spark: SparkSession, path: str, version: int, value: dict) -> None:
    """Readers see the whole new version or the one before; a version that is there already is a conflict."""
    create_bytes(spark, f"{path}/{version:012d}.json", json.dumps(value).encode())


@contextlib.contextmanager
def temporary(spark: SparkSession, path: str) -> Iterator[str]:
    """A path that is deleted at the end."""
    try:
        yield path
    finally:
        delete(spark, path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted when each query ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Rows that one file of a store should hold.
FILE_ROWS = 1_000_000
#: A power of two; coarser bucket numbers are its remainders.
MOST_BUCKETS = 1 << 12


def layout(rows: DataFrame, fine, file_rows: int = FILE_ROWS, least: int = 16) -> tuple[int, dict[int, int]]:
    """(buckets, files of each bucket) from counts of all rows by their fine bucket number (below ``MOST_BUCKETS``).

    Buckets grow with the rows; one with more rows than a file should hold is dealt to several files.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(fine.alias("fine")).count().collect()}  # at most MOST_BUCKETS numbers
    buckets, total = least, sum(counts.values())
    while buckets < MOST_BUCKETS and buckets * file_rows < total:
        buckets *= 2
    return buckets, spread_of(counts, buckets, file_rows)


def spread_of(counts: dict[int, int], buckets: int, file_rows: int = FILE_ROWS) -> dict[int, int]:
    sizes: dict[int, int] = {}
    for fine, n in counts.items():
        sizes[fine % buckets] = sizes.get(fine % buckets, 0) + n
    return {b: -(-n // file_rows) for b, n in sizes.items()}


def dealt(rows: DataFrame, spread: dict[int, int], seq) -> DataFrame:
    """Rows with a column ``bucket``, in partitions of one file each."""
    if not spread:
        return rows
    wide = {b: n for b, n in spread.items() if n > 1}
    parts = F.lit(1)
    if wide:
        parts = F.coalesce(F.create_map(*[F.lit(x) for pair in wide.items() for x in pair])[F.col("bucket")], F.lit(1))
    return rows.repartition(sum(spread.values()), "bucket", F.pmod(F.xxhash64(seq), parts))
