"""Archive and log files in byte layouts, as tables of files (path, content) and as rows.

``binary_files`` reads any path that Spark reads (files up to 2 GB).  Writing makes one file of each value of a column.
A log file is the unit of work, so a large log should be many files.  An archive file of any size is written and read in
parts (path, part, content) of ``PART`` bytes, the last one shorter: Python holds batches and one table of a space's keys,
Spark sorts what lies between.  Events of a space, entries of an index key and a file's parts are passed on by one task each.

Modes: ``FAILFAST`` raises on a torn last record, ``DROP_TAIL`` leaves it out; a wrong header or footer is always an error.
Nulls: a null content gives no rows; null groupings are written as ``''``, null payloads as empty ones, which in archives are an error;
in archives an index entry without a value has no key.
"""

from __future__ import annotations

import struct
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import index_keys
from . import codec
from .errors import FormatError

ARCHIVE = "path string, space string, grouping string, pos long, ts long, data binary, keys array<string>"
LOG = "path string, seq long, offset long, data binary, prev map<string,long>"
ROWS = 10_000
#: Bytes of values that a batch should hold, and the rows of a batch that are turned into Python values at a time.
BYTES, FEW = 1 << 22, 256
#: Bytes of a file in one of its parts.
PART = 1 << 16
PARTS = "path string, part int, content binary"
#: What is on its way into a file: events' blocks of groupings (``key`` g...), and entries or blocks of index keys (i...).
FLOW = "path string, space string, key binary, ts long, no long, body binary"
FLOW_ARROW = pa.schema([("path", pa.string()), ("space", pa.string()), ("key", pa.binary()), ("ts", pa.int64()), ("no", pa.int64()), ("body", pa.binary())])
SECTIONS = "path string, space string, key binary, base long, at long, size long"
SECTIONS_ARROW = pa.schema([("path", pa.string()), ("space", pa.string()), ("key", pa.binary()), ("base", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
PIECES = "path string, space string, key binary, at long, part int, body binary"
PIECES_ARROW = pa.schema([("path", pa.string()), ("space", pa.string()), ("key", pa.binary()), ("at", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])
DECODED = "path string, space string, block long, byte long, grouping string, pos long, ts long, data binary, key string"
DECODED_ARROW = pa.schema([("path", pa.string()), ("space", pa.string()), ("block", pa.int64()), ("byte", pa.int64()), ("grouping", pa.string()), ("pos", pa.int64()), ("ts", pa.int64()), ("data", pa.binary()), ("key", pa.string())])


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _in_batches(rows, schema: pa.Schema):
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) == ROWS or size >= BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(stream):
    for batch in stream:
        for at in range(0, batch.num_rows, FEW):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, FEW).columns], strict=True)


def _same(*places: int):
    return lambda row: tuple(row[k] for k in places)


def _files(stream):
    for batch in stream:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            raw = content.as_py()
            if raw is not None:
                yield path, raw


def read_archives(files: DataFrame) -> DataFrame:
    """Events of archive files: ``pos`` is the place in the grouping's scan order, ``keys`` the index keys the event is on."""
    return read_archive_parts(file_parts(files))


def file_parts(files: DataFrame) -> DataFrame:
    """(path, part, content) of files (path, content)."""
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("content", pa.binary())])

    def run(stream):
        yield from _in_batches(((path, k, raw[at : at + PART]) for path, raw in _files(stream) for k, at in enumerate(range(0, max(1, len(raw)), PART))), schema)

    return files.select("path", "content").mapInArrow(run, PARTS)


def read_archive_parts(parts: DataFrame) -> DataFrame:
    """:func:`read_archives` of files in parts.

    The tables at the ends of files and spaces give the sections, parts are cut into these, sections are read through
    their blocks, and events meet their index entries where both point to.
    """

    def find(stream):
        files = groupby(_rows(stream), key=_same(0))
        yield from _in_batches(((path, *section) for (path,), own in files for section in codec.archive_sections((k * PART, raw) for _, k, raw in own)), SECTIONS_ARROW)

    def cuts(stream):
        for (path, part), own in groupby(_rows(stream), key=_same(0, 1)):
            raw = None
            for _, _, content, space, key, base, at, size in own:
                if key is None:
                    raw = content
                    continue
                low, high = max(base + at - part * PART, 0), min(base + at + size - part * PART, PART)
                if raw is None or len(raw) < high:
                    raise FormatError("a section does not fit the file")
                yield path, space, key, at, part, raw[low:high]

    def cut(stream):
        yield from _in_batches(cuts(stream), PIECES_ARROW)

    def decoded(stream):
        for (path, space, key, at), own in groupby(_rows(stream), key=_same(0, 1, 2, 3)):
            pieces, name = (row[5] for row in own), key[1:].decode()
            if key[:1] == b"g":
                for block, byte, place, ts, data in codec.section_events(pieces, at):
                    yield path, space, block, byte, name, place, ts, data, None
            elif key[:1] == b"i":
                for block, byte in codec.section_entries(pieces, at):
                    yield path, space, block, byte, None, None, None, None, name

    def decode(stream):
        yield from _in_batches(decoded(stream), DECODED_ARROW)

    parts = parts.where("content is not null").select("path", "part", "content")
    sections = parts.repartition("path").sortWithinPartitions("path", F.desc("part")).mapInArrow(find, SECTIONS).where("size > 0")
    wanted = sections.withColumn("part", F.explode(F.expr(f"sequence(int((base + at) div {PART}), int((base + at + size - 1) div {PART}))")))
    both = parts.unionByName(wanted, allowMissingColumns=True).repartition("path", "part").sortWithinPartitions("path", "part", F.asc_nulls_first("key"))
    pieces = both.select("path", "part", "content", "space", "key", "base", "at", "size").mapInArrow(cut, PIECES)
    rows = pieces.repartition("path", "space", "key").sortWithinPartitions("path", "space", "key", "part").mapInArrow(decode, DECODED)
    event = F.first(F.when(F.col("pos").isNotNull(), F.struct("grouping", "pos", "ts", "data")), ignorenulls=True)
    met = rows.repartition("path", "space", "block", "byte")  # rows are smaller than what they would be aggregated to before a shuffle
    found = met.groupBy("path", "space", "block", "byte").agg(event.alias("e"), F.sort_array(F.collect_list("key")).alias("keys"))
    return found.where("e is not null").select("path", "space", "e.grouping", "e.pos", "e.ts", "e.data", "keys")


def read_logs(files: DataFrame, mode: str = "FAILFAST", header: bytes = codec.LOG_HEADER) -> DataFrame:
    """Events of log files, with the byte offset of each and of the older event on each of its keys."""
    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("prev", pa.map_(pa.string(), pa.int64()))])

    def run(stream):
        rows = ((path, k + 1, at, data, list(prev.items())) for path, raw in _files(stream) for k, (at, data, prev) in enumerate(codec.read_log(raw, mode, header)))
        yield from _in_batches(rows, schema)

    return files.select("path", "content").mapInArrow(run, LOG)


def archive_files(events: DataFrame, path: str) -> DataFrame:
    """(path, content): one archive file of the events (space, grouping, ts, seq, data, indexes) of each value of the column ``path``."""
    return archive_parts(events, path).groupBy("path").agg(F.expr("listagg(content) within group (order by part)").alias("content"))


def archive_parts(events: DataFrame, path: str) -> DataFrame:
    """The files of :func:`archive_files` as (path, part, content).

    Groupings are written first, since index entries point into them; then the entries of each key; then files are joined.
    """

    def written(stream):
        for (name, space), own in groupby(_rows(stream), key=_same(0, 1)):
            at = 1  # after the mark
            for (key,), events in groupby(own, key=_same(2)):
                writer, no = codec.BlockWriter(), 0
                for *_, ts, seq, data, keys in events:
                    if not data:
                        raise FormatError("an event needs data")
                    where = struct.pack("<qH", at + writer.written, writer.buffered)
                    writer.write(codec.varint(len(data)) + struct.pack("<I", ts & 0xFFFFFFFF) + data)
                    for k in keys or []:
                        yield name, space, b"i" + k.encode(), ts, seq, where
                    if len(writer.out) >= PART:
                        yield name, space, key, None, no, writer.drain()
                        no += 1
                writer.write(b"\0")
                writer.flush()
                yield name, space, key, None, no, writer.drain()
                at += writer.written

    def write(stream):
        yield from _in_batches(written(stream), FLOW_ARROW)

    def indexed(stream):
        for (name, space, key), own in groupby(_rows(stream), key=_same(0, 1, 2)):
            if key[:1] == b"g":
                yield from own
                continue
            writer, no = codec.BlockWriter(), 0
            for row in own:
                writer.write(row[5])
                if len(writer.out) >= PART:
                    yield name, space, key, None, no, writer.drain()
                    no += 1
            writer.write(b"\0")
            writer.flush()
            yield name, space, key, None, no, writer.drain()

    def index(stream):
        yield from _in_batches(indexed(stream), FLOW_ARROW)

    def parts(stream):
        for (name,), own in groupby(_rows(stream), key=_same(0)):
            held, part = bytearray(), 0
            for piece in codec.archive_pieces((space, key, body) for _, space, key, _, _, body in own):
                held += piece
                while len(held) >= PART:
                    yield name, part, bytes(held[:PART])
                    del held[:PART]
                    part += 1
            if held:
                yield name, part, bytes(held)

    def join(stream):
        yield from _in_batches(parts(stream), pa.schema([("path", pa.string()), ("part", pa.int32()), ("content", pa.binary())]))

    key = F.concat(F.lit("g"), F.coalesce("grouping", F.lit(""))).cast("binary")
    rows = events.select(F.col(f"`{path}`").cast("string").alias("path"), "space", key.alias("key"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("no"), F.col("data").cast("binary").alias("data"), index_keys(F.col("indexes")).alias("keys"))
    newest_first = [F.desc("ts"), F.asc_nulls_last("no")]
    groupings = rows.repartition("path", "space").sortWithinPartitions("path", "space", "key", *newest_first).mapInArrow(write, FLOW)
    sections = groupings.repartition("path", "space", "key").sortWithinPartitions("path", "space", "key", *newest_first).mapInArrow(index, FLOW)
    return sections.repartition("path").sortWithinPartitions("path", "space", "key", "no").mapInArrow(join, PARTS)


def log_files(log: DataFrame, path: str = "stream", seal: bool = True, header: bytes = codec.LOG_HEADER, footer: bytes = codec.LOG_FOOTER) -> DataFrame:
    """(path, content): one log file of the events (seq, data, indexes) of each value of the column ``path``."""

    def built(stream):
        for (name,), own in groupby(_rows(stream), key=_same(0)):
            events = ((data or b"", dict(indexes or [])) for _, _, data, indexes in own)
            yield name, codec.log_bytes(events, seal, header, footer)

    def build(stream):
        yield from _in_batches(built(stream), pa.schema([("path", pa.string()), ("content", pa.binary())]))

    rows = log.select(F.col(f"`{path}`").cast("string").alias("path"), "seq", F.col("data").cast("binary").alias("data"), "indexes")
    return rows.repartition("path").sortWithinPartitions("path", F.asc_nulls_last("seq")).mapInArrow(build, "path string, content binary")


def serialized(data: Column, indexes: Column, tails: Column) -> Column:
    """A log record's bytes; ``tails``: map<string,long> of the offsets of the older records.  Null data is empty, null maps have no entries."""

    @F.arrow_udf("binary")
    def run(d: pa.Array, i: pa.Array, t: pa.Array) -> pa.Array:
        rows = zip(d, i.to_pylist(), t.to_pylist(), strict=True)
        return pa.array([codec.serialize(x.as_py() or b"", dict(m or []), dict(o or [])) for x, m, o in rows], pa.binary())

    return run(data.cast("binary"), indexes, tails)


def blocked(data: Column, size: int = codec.BLOCK) -> Column:
    """Bytes cut into blocks; null stays null."""

    @F.arrow_udf("binary")
    def run(d: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else codec.blocks(x.as_py(), size) for x in d], pa.binary())

    return run(data.cast("binary"))


def unblocked(data: Column, size: int = codec.BLOCK, block: int = 0, length: int | None = None) -> Column:
    """The bytes of blocks from the given block on, all or so many; a block beyond the end gives none."""

    @F.arrow_udf("binary")
    def run(d: pa.Array) -> pa.Array:
        out = []
        for x in d:
            raw = x.as_py()
            if raw is not None:
                reader, at, width = codec.BlockReader(raw, size), 0, 2 if size < 1 << 16 else 4
                for _ in range(block):  # headers alone are read on the way
                    at += width + 1 + int.from_bytes(raw[at : at + width], "little") if at < len(raw) else 0
                reader.seek(at)
                raw = reader.peek(length) if length is not None else codec.read_blocks(raw[at:], size)
            out.append(raw)
        return pa.array(out, pa.binary())

    return run(data)
