"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, become
an 8-bit grey PNG image of width 576: lossless, with the size in a header at a fixed
place.  Every distinct image is stored once, under the SHA-256 of its payload, in
tar shards of bounded size in the shared folder.  A row carries digest, shard, offset and length.
Metadata come from range reads of the image's first 33 bytes; features from
the whole image, once per distinct payload.

Defined cases: a null text is empty and gives 576 bytes of 255; equal texts share one
image; repeated rows get equal results; a null doc_id is kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk: all that metadata need.
HEAD = 33
SHARD_BYTES = 256 << 20


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def encode(payload: bytes) -> bytes:
    """8-bit grey PNG, one row per 576 bytes, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def metadata(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not an image header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(image: bytes) -> bytes:
    width, height, _ = metadata(image[:HEAD])
    (size,) = struct.unpack(">I", image[HEAD : HEAD + 4])
    body = image[HEAD + 4 : HEAD + 8 + size]
    if body[:4] != b"IDAT" or struct.unpack(">I", image[HEAD + 8 + size : HEAD + 12 + size])[0] != zlib.crc32(body):
        raise ValueError("damaged image")
    return np.frombuffer(zlib.decompress(body[4:]), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step to the next one."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    value = np.arange(256)
    mean = float(share @ value)
    deviation = float(np.sqrt(max(0.0, share @ (value - mean) ** 2)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={entropy:.4f};step={step:.4f}"


def location(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


INDEX = "digest string, shard string, offset long, length long"


class ShardWriter:
    """Writes tar shards under names of its own; a shard has its final name only when it is complete."""

    def __init__(self, folder: str):
        (self.fs, self.folder), self.out = location(folder), None
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, digest: str, image: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(self.name + ".part")
        info = tarfile.TarInfo(digest + ".png")
        info.size = len(image)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + image + b"\0" * (-len(image) % 512))
        offset = self.at + len(head)
        self.at = offset + len(image) + -len(image) % 512
        name = self.name
        if self.at >= SHARD_BYTES:
            self.close()
        return name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.fs.move(self.name + ".part", self.name)
            self.out = None


def store(docs: DataFrame, text: str = "text", passes: int = 2) -> DataFrame:
    """digest, shard, offset, length: where each distinct payload is stored.

    The images go to their shards in ``passes`` rounds by digest, so that a round's
    shuffle files are gone before the next one's are written.
    """
    spark = docs.sparkSession
    folder = common.new_path(spark, "media")
    images = pa.schema([("digest", pa.string()), ("image", pa.binary())])
    places = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def draw(stream, k):
        for batch in stream:
            seen, out, size = set(), {f.name: [] for f in images}, 0
            for body in batch["text"]:
                payload = padded(body.as_py())
                digest = hashlib.sha256(payload).digest()
                if digest in seen or digest[-1] % passes != k:
                    continue
                seen.add(digest)
                out["digest"].append(digest.hex())
                out["image"].append(encode(payload))
                size += len(out["image"][-1])
                if size > 16 << 20:
                    yield common.batches(out, images)
                    out, size = {f.name: [] for f in images}, 0
            yield common.batches(out, images)

    def write(stream):
        writer, last = ShardWriter(folder), None
        out = {f.name: [] for f in places}
        for batch in stream:
            for digest, image in zip(batch["digest"].to_pylist(), batch["image"], strict=True):
                if digest != last:
                    image = image.as_py()
                    shard, offset = writer.add(digest, image)
                    for name, value in zip(places.names, (digest, shard, offset, len(image)), strict=True):
                        out[name].append(value)
                    last = digest
        writer.close()  # rows leave only when their shards are complete
        yield common.batches(out, places)

    index = None
    for k in range(passes):
        drawn = docs.select(common.text_column(docs, text).alias("text")).mapInArrow(common.lean(lambda stream, k=k: draw(stream, k)), "digest string, image binary")
        dealt = drawn.repartition(common.partitions(spark), "digest").sortWithinPartitions("digest")
        part = common.materialize(dealt.mapInArrow(common.lean(write), INDEX), f"media-index-{k}")
        index = part if index is None else index.unionByName(part)
    index.media_folder = folder
    return index


def ranges(folder: str, batch: pa.RecordBatch, size: int | None = None):
    """The stored bytes of an index batch, or only the first ``size`` of each."""
    fs, handle, name = location(folder)[0], None, None
    for shard, offset, length in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
        if shard != name:
            if handle is not None:
                handle.close()
            handle, name = fs.open_input_file(shard), shard
        handle.seek(offset)
        yield handle.read(length if size is None else min(size, length))
    if handle is not None:
        handle.close()


def in_shard_order(index: DataFrame) -> DataFrame:
    return index.repartition(common.partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "offset")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits, read from the images' headers only."""
    schema = "digest string, shard string, offset long, length long, width long, height long, bits int"

    def run(stream):
        for batch in stream:
            found = [metadata(h) for h in ranges(folder, batch, HEAD)]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "width", "height", "bits"])

    return in_shard_order(index).mapInArrow(common.lean(run), schema)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Per distinct payload, from the stored bytes: its digest, checksums and features, and the header's metadata."""
    schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(stream):
        for batch in stream:
            out = {f.name: [] for f in schema}
            for digest, image in zip(batch["digest"].to_pylist(), ranges(folder, batch), strict=True):
                payload = decode(image)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"payload {digest} is damaged")
                for name, value in zip(schema.names, (digest, len(payload), found, zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)), strict=True):
                    out[name].append(value)
            yield common.batches(out, schema)

    return in_shard_order(index).mapInArrow(common.lean(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media columns; one row per input row."""
    index = store(docs, text)
    folder = index.media_folder
    read = common.materialize(read_back(index, folder), "media-features")
    heads = common.materialize(with_metadata(index, folder), "media-heads").drop("bits")
    raw = F.coalesce(common.text_column(docs, text), F.lit("")).cast("binary")
    pad = F.when(F.octet_length("raw") == 0, WIDTH).otherwise(F.pmod(-F.octet_length("raw"), F.lit(WIDTH)))
    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), raw.alias("raw"))
    named = rows.select("doc_id", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2(F.concat("raw", F.unhex(F.repeat(F.lit("FF"), pad.cast("int")))), 256).alias("digest"))
    known = read.join(heads, "digest")
    return named.join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", F.regexp_extract("shard", "[^/]+$", 0).alias("shard"), "offset", "length"
    )
