"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint takes, for every bit, the majority over the XXH64 hashes of
all 3-word shingles.  Fingerprints link when at most 3 bits differ.

Candidate search: the fingerprint is cut into two 32-bit segments, so of 3
differing bits one segment holds at most one.  Every segment is indexed with each of
its bits wildcarded in turn (32 variants), and two segments that differ in at most one bit
share the variant that hides it.  An equality shuffle on the variants brings the
candidates together and each candidate is verified on the full 64 bits.

A variant key that many distinct fingerprints share is not compared pair by pair:
the rows go one level deeper, where the bits not yet fixed by the key are cut
into two segments again.  A level at least halves the free bits, so after at most
four levels a key has under 2**8 possible members.  A key emits a spanning forest of its
links (each fingerprint with the smallest one it is connected to), never all pairs.

Defined cases: a null or wordless text has fingerprint zero and is linked like any
other; fewer than 3 words make one shingle; identical fingerprints are one node,
however many rows share it; a null doc_id takes part and never becomes a component's id
unless all ids in it are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, near

SEED = 42
MAX_BITS = 3
#: Distinct fingerprints of a key that are compared directly; more go a level deeper.
DIRECT = 256
PIECE = 1 << 16


def bit_rows() -> np.ndarray:
    """Byte value -> its 8 bits, most significant first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, bits: np.ndarray, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    tally = np.zeros(2048, np.int64)
    digest, place = xxhash.xxh64_intdigest, np.arange(8) * 256
    for at in range(0, n, PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)], ">u8")
        tally += np.bincount((h.view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048)
    ones = (tally.reshape(8, 256) @ bits).ravel()
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): one row per input row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(stream):
        bits = bit_rows()
        for batch in stream:
            fps = [fingerprint(t.as_py(), bits, shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64))], schema=schema)

    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))
    return rows.mapInArrow(common.lean(compute), "doc_id long, fp long")


def keys_of(fps: np.ndarray, free: np.ndarray, path: np.ndarray, level: int):
    """Variant keys of fingerprints whose free bits (the same for all) are given by mask bits.

    Yields (key, free mask below that key) for every segment and wildcard.
    ``path`` is a hash of the keys so far.
    """
    order = [b for b in range(63, -1, -1) if int(free) >> b & 1]
    half = (len(order) + 1) // 2
    for segment in (order[:half], order[half:]):
        whole = sum(1 << b for b in segment)
        for wild in segment:
            fixed = np.uint64(whole & ~(1 << wild))
            tag = np.uint64((level << 8 | wild) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            yield common.mix(common.mix((fps & fixed) ^ tag) + path), np.uint64(int(free) & ~int(fixed))


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one key as a forest: every fingerprint with the smallest one connected to it."""
    n = len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(n)
    while True:
        best = np.where(near, label[None, :], n).min(1)
        best = best[best]
        if (best == label).all():
            break
        label = best
    root = label != np.arange(n)
    return fps[root], fps[label[root]]


def runs_to_links(stream, depth: int, max_bits: int, direct: int):
    """Rows sorted by (key, fp) -> links found, and rows of keys that need another level."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("free", pa.int64())])

    def emit(us, vs, keys, frees):
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (us, vs, keys, frees)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols], schema=schema)

    held_fp, held_free, held_key = np.zeros(0, np.uint64), np.uint64(0), None

    def flush(fps, key, free, deep):
        """The complete run, or a full piece of one that already is too long."""
        if deep:
            for k, below in keys_of(fps, free, np.uint64(key), depth):
                yield [fps.copy()], [np.zeros(len(fps), np.uint64)], [k], [np.full(len(fps), below, np.uint64)]
        elif len(fps) > 1:
            a, b = forest(fps, max_bits)
            if len(a):
                zero = np.zeros(len(a), np.uint64)
                yield [a], [b], [zero], [zero]

    deep = False
    for batch in stream:
        key = batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)
        fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        free = batch["free"].to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(cuts[1:], len(key))
        found = []
        # a run that has company, or may go on from or into another batch
        some = np.flatnonzero((ends - cuts > 1) | (cuts == 0) | (ends == len(key)))
        for a, b in zip(cuts[some].tolist(), ends[some].tolist(), strict=True):
            if held_key is not None and key[a] != held_key:
                found += flush(held_fp, held_key, held_free, deep)
                held_key, deep = None, False
            held_fp = np.unique(fp[a:b]) if held_key is None else np.unique(np.concatenate([held_fp, fp[a:b]]))
            held_key, held_free = key[a], free[a]
            if len(held_fp) > direct and bin(int(held_free)).count("1") > 8:
                found += flush(held_fp, held_key, held_free, True)
                held_fp, deep = held_fp[:0], True
        if found:
            yield emit(*[[x for f in found for x in f[i]] for i in range(4)])
    if held_key is not None:
        for f in flush(held_fp, held_key, held_free, deep):
            yield emit(*f)


def links(fps: DataFrame, max_bits: int = MAX_BITS, direct: int = DIRECT) -> DataFrame:
    """u, v: a set of links with the same connected components as all pairs of distinct ``fp`` within ``max_bits``.

    The pigeonhole over two segments holds for ``max_bits`` up to 3.
    """
    if max_bits > 3:
        raise ValueError("two segments find at most 3 differing bits")
    spark = fps.sparkSession
    parts = common.partitions(spark)

    def first(stream):
        schema = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("free", pa.int64())])
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        for batch in stream:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                for key, below in keys_of(part, everything, np.uint64(0), 0):
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(key.view(np.int64)), pa.array(np.full(len(part), below, np.uint64).view(np.int64))], schema=schema)

    rows = fps.mapInArrow(common.lean(first), "fp long, key long, free long")
    found = None
    for depth in range(1, 7):
        level = rows.repartition(parts * 2, "key").sortWithinPartitions("key", "fp")
        out = common.materialize(level.mapInArrow(common.lean(lambda s, d=depth: runs_to_links(s, d, max_bits, direct)), "u long, v long, key long, free long"), f"simhash-{depth}")
        got = out.where("free = 0").select("u", "v")
        found = got if found is None else found.union(got)
        rows = out.where("free <> 0").select(F.col("u").alias("fp"), "key", "free")
        if rows.isEmpty():
            return found.distinct()
    raise AssertionError("free bits did not shrink")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, direct: int = DIRECT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included)."""
    fps = common.materialize(fingerprints(docs, doc_id, text), "simhash-fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = graph.components(links(nodes.select("fp"), max_bits, direct))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    named = common.materialize(named, "simhash-named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = common.materialize(named.join(smallest, "root").select("fp", "n", "component_id"), "simhash-components")
    return common.hot_join(fps, by_fp, "fp", "n", F.coalesce("doc_id", F.lit(0))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", direct: int = near.DIRECT) -> DataFrame:
    """node, doc_id, root: every distinct text with its smallest id and the node whose group it is in.

    Groups are the connected components of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.
    """
    rows = common.materialize(near.fingerprints(docs, doc_id, text), "near-fingerprints")
    nodes = common.materialize(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("fp").alias("fp")), "near-nodes")
    common.discard(rows)
    roots = graph.components(near.links(nodes, docs, doc_id, text, direct))
    named = nodes.select("node", "doc_id").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    groups = common.materialize(named.select("node", "doc_id", F.coalesce("root", "node").alias("root")), "near-groups")
    common.discard(nodes)
    return groups


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", direct: int = near.DIRECT) -> DataFrame:
    """One document of each group of near copies (the smallest id, of several texts with it one), columns unchanged.

    Every group keeps exactly one row, whatever its ids; null ids come last.
    """
    key, part = common.unused(docs, "group_key", "group_part")
    groups = near_groups(docs, doc_id, text, direct)
    none = F.lit(2**63 - 1)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))).alias("m"))
    # the texts are dealt out once, by text and id, for the join and for repeated rows
    kept = first.select(F.col("m.node").alias(key), F.coalesce("m.id", none).alias(part))
    own = docs.withColumns({key: near.node_of(common.text_column(docs, text)), part: F.coalesce(common.long_column(docs, doc_id), none)})
    return own.join(kept, [key, part], "left_semi").dropDuplicates([key, part]).select(*[F.col(f"`{c}`") for c in docs.columns])
