"""Near copies by SimHash: candidates from segments with deletion variants, groups from the word shingles themselves.

Two texts are near copies when the Jaccard similarity of their sets of 5-word shingles is 0.8 or more.
At 0.8 two fingerprints of :mod:`simhash` differ in about 10 of 64 bits, which no two segments can
hide, so a fingerprint here is longer: every bit is again the majority over the hashes of all shingles, and each
word of 64 bits mixes the hashes anew.  Three words are for the comparison, the others are cut into 64 segments of 24 bits
(128 for texts of up to 20 shingles, where a shingle weighs more).

Candidate search: every segment is indexed with each of its six runs of 4 bits deleted in turn, and two
segments whose differences are all in one run share the variant that lacks it: a pair at 0.8 shares none of the
variants with a chance under 2e-4, one at 0.85 under 2e-6.  Variants that lack a run of the same half of a segment have the other half
in common, so a text is shuffled once for each half, by that half, and its variants are formed where it arrives.  Texts
with equal variants are candidates, and those that differ in at most 64 of the 192 bits of the comparison are linked: a pair at 0.8
differs in 29 and exceeds 64 with a chance under 1e-6 (texts of four shingles in 36, under 1e-5), unrelated texts differ in
96 and pass with a chance of 3e-6.  A task emits a spanning forest of its links, never all pairs.  The first few segments are
searched before the others, which then link only what is not yet connected.

Verification: the connected candidates are a cluster, and all its texts are compared by the 64-bit
hashes of their shingles, whether they shared a variant or not.  A cluster of more than ``direct`` texts is cut into blocks
and every two blocks meet in a task of their own, so no link is lost; each task emits a forest of what it verified.

Defined cases: words are those of :func:`simhash.fingerprint`; fewer than 5 words make one shingle; texts without words are
near copies of each other and of nothing else; equal texts are one node, however many rows have them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .minhash import node_of, shingles

#: Words of 64 bits that are compared; bytes of a segment, and the runs of 4 bits of which one is deleted.
CHECK, BYTES, RUNS = 3, 3, 6
#: Bits of half a segment.
HALF = 4 * BYTES
SEGMENTS = 64
#: Up to so many shingles a text has twice the segments.
SHORT = 20
#: Differing bits of 192 up to which candidates are linked.
RADIUS = 64
#: Segments by round: few first, since what they connect is not linked again.
ROUNDS = [(0, 4), (4, 24), (24, 44), (44, 64)]
#: Texts of a cluster that are compared in one task.
DIRECT = 1024
#: Shingles for which a text of a block counts on average, and columns of a matrix of them.
EACH, COLUMNS = 512, 2048
#: Shingles that are counted at once, in a byte.
PIECE = 255
#: What is shuffled: a key, the text's label, and the words of the comparison.
ROW = ["key", "label", "a", "b", "c"]


def wide(hashes: np.ndarray) -> bytes:
    """The majority bits of the shingles, words of 64 bits one after the other; no shingles: zeros."""
    words = CHECK + SEGMENTS * BYTES // 8 * (2 if len(hashes) <= SHORT else 1)
    tags = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), PIECE):
        mixed = common.mix(hashes[at : at + PIECE, None] + tags).astype(">u8")
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, doc_id, n (distinct shingles), fp: one row per input row."""
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary())])

    def compute(stream):
        for batch in stream:
            sets = [shingles(t.as_py()) for t in batch["text"]]
            fps = pa.array([wide(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["node"], batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), fps], schema=schema)

    body = common.text_column(docs, text)
    rows = docs.select(node_of(body).alias("node"), common.long_column(docs, doc_id).alias("doc_id"), body.alias("text"))
    return rows.mapInArrow(common.lean(compute), "node long, doc_id long, n long, fp binary")


def routes(parts: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Rows of fingerprint bytes -> two keys of 32 bits for each of the segments ``begin`` to ``end`` (and those of short texts).

    A key is the segment's number and which half stays, that half, and the half of which a run is deleted.
    """
    which = np.concatenate([np.arange(at + begin, at + end) for at in range(0, parts.shape[1] // BYTES, SEGMENTS)]).astype(np.uint64)
    segment = parts.reshape(len(parts), -1, BYTES)[:, which].astype(np.uint64) @ np.array([1 << 16, 1 << 8, 1], np.uint64)
    half, low = np.uint64(HALF), np.uint64((1 << HALF) - 1)
    turned = (segment & low) << half | segment >> half
    tag = which << np.uint64(2 * HALF + 1)
    return np.stack([tag | segment, tag | np.uint64(1 << 2 * HALF) | turned], 2).reshape(len(parts), -1)


def hidden(keys: np.ndarray) -> list[np.ndarray]:
    """Keys of :func:`routes` -> for each run of the half that does not stay, the keys of the variants that lack it."""
    return [keys & ~np.uint64(15 << 4 * run) | np.uint64(run << 32) for run in range(RUNS // 2)]


def variants(parts: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Rows of fingerprint bytes -> rows of keys: segments ``begin`` to ``end`` (and those of short texts) with each run deleted."""
    return np.concatenate(hidden(routes(parts, begin, end)), 1)


def keyed(stream, begin: int, end: int):
    """label, fp -> key, label and the words of the comparison, for both halves of every segment."""
    for batch in stream:
        label = batch["label"].to_numpy(zero_copy_only=False)
        fps = batch["fp"].to_pylist()
        size = np.array([len(f) for f in fps])
        for width in np.unique(size).tolist():
            own = np.flatnonzero(size == width)
            for at in range(0, len(own), 512):
                rows = own[at : at + 512]
                raw = np.frombuffer(b"".join([fps[k] for k in rows.tolist()]), np.uint8).reshape(len(rows), width)
                keys = routes(raw[:, 8 * CHECK :], begin, end)
                check = np.ascontiguousarray(raw[:, : 8 * CHECK]).view(np.int64)
                columns = [keys.view(np.int64).ravel()] + [np.repeat(c, keys.shape[1]) for c in (label[rows], *check.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=ROW)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each is connected to by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        # the links' ends, and what the ends pointed to
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(now, ends, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def run_roots(fps: np.ndarray) -> np.ndarray:
    """The first row that each row of one long run is connected to; compared only with rows that are not connected yet."""
    label, left = np.arange(len(fps)), np.arange(len(fps))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            take = max(1, (1 << 19) // len(left))
            near = np.bitwise_count(fps[front[:take], None] ^ fps[None, left]).sum(2, dtype=np.int64) <= RADIUS
            hit = near.any(0)
            label[left[hit]] = root
            front, left = np.concatenate([front[take:], left[hit]]), left[~hit]
    return label


def run_links(key: np.ndarray, label: np.ndarray, fps: np.ndarray, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Whole runs of equal keys -> a forest of the links between labels."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    long = np.diff(np.append(cuts, len(key)))
    us, vs = [], []
    for at, size in zip(cuts[long > few].tolist(), long[long > few].tolist(), strict=True):
        us.append(label[at : at + size])
        vs.append(us[-1][run_roots(fps[at : at + size])])
    row = np.flatnonzero(np.repeat((long > 1) & (long <= few), long))
    ends = np.repeat(cuts + long, long)
    for step in range(1, few):
        row = row[row + step < ends[row]]
        if not len(row):
            break
        near = np.bitwise_count(fps[row] ^ fps[row + step]).sum(1, dtype=np.int64) <= RADIUS
        us.append(label[row[near] + step])
        vs.append(label[row[near]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (label[:0], label[:0])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same connected components, one at most for each end."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots(ends[: len(u)], ends[len(u) :], len(names))
    some = root != np.arange(len(names))
    return names[some], names[root[some]]


def whole_runs(stream, bits: int = 0):
    """Rows sorted by key -> arrays of rows with all that have one key, but for its last ``bits`` bits."""
    held: list[np.ndarray] = []
    for batch in stream:
        if not len(batch):
            continue
        rows = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ROW], 1)
        if held and held[0][0, 0] >> bits == rows[-1, 0] >> bits:  # one run fills the batch and may go on
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows])
        other = rows[::-1, 0] >> bits != rows[-1, 0] >> bits
        last = len(rows) - int(other.argmax()) if other.any() else 0
        if last:
            yield rows[:last]
        held = [rows[last:]]
    if held:
        yield np.concatenate(held)


def opened(stream):
    """Rows sorted by key -> each row under its variants' keys, equal ones next to each other."""
    for rows in whole_runs(stream, HALF):
        for key in hidden(rows[:, 0].view(np.uint64)):
            order = np.argsort(key, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(key[order].view(np.int64)), *[pa.array(c) for c in rows[order, 1:].T]], names=ROW)


def linked(stream):
    """Rows with equal keys next to each other -> u, v: a forest of all links of the task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    u = v = np.zeros(0, np.int64)
    for rows in whole_runs(stream):
        a, b = run_links(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64))
        other = a != b
        if other.any():
            u, v = forest(np.concatenate([u, a[other]]), np.concatenate([v, b[other]]))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)


def candidates(nodes: DataFrame, begin: int, end: int, parts: int) -> DataFrame:
    """u, v: links between the labels of texts that share a variant of the segments and are near by the words of the comparison."""
    keys = nodes.select("label", "fp").mapInArrow(common.lean(lambda s: keyed(s, begin, end)), "key long, label long, a long, b long, c long")
    runs = keys.repartition(parts, F.shiftright("key", HALF)).sortWithinPartitions("key")
    return common.materialize(runs.mapInArrow(common.lean(lambda s: linked(opened(s))), "u long, v long").distinct(), f"near-candidates-{begin}")


def clusters(nodes: DataFrame) -> DataFrame:
    """node, root: every text that has a candidate, with the smallest node of its cluster."""
    parts = common.scaled(nodes, 1 << 20)
    found = candidates(nodes.withColumn("label", F.col("node")), *ROUNDS[0], parts)
    first = graph.components(found)
    named = nodes.join(first, "node", "left").select(F.coalesce("root", "node").alias("label"), "fp")
    named = common.materialize(named, "near-named")
    rest = [candidates(named, begin, end, parts) for begin, end in ROUNDS[1:]]
    common.discard(named)
    links = first.select(F.col("node").alias("u"), F.col("root").alias("v"))
    for more in rest:
        links = links.union(more)
    return graph.components(links)


def same(sets: list[np.ndarray]) -> np.ndarray:
    """The first set that each is connected to by similarities of 0.8 or more."""
    n = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    owner, again = np.repeat(np.arange(len(sets)), n), shared[column]
    owner, column = owner[again], (np.cumsum(shared) - 1)[column[again]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        matrix = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - at)), np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        both += matrix @ matrix.T
    return roots(*np.nonzero(np.triu(9 * both >= 4 * (n[:, None] + n), 1)), len(sets))


def verified(stream):
    """Rows sorted by (root, tile) -> u, v: a forest of the links between the texts of each task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held, nodes, sets = None, [], []

    def settle():
        first = same(sets)
        some = np.flatnonzero(first != np.arange(len(sets)))
        ids = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[first[some]])], schema=schema)

    for batch in stream:
        for root, tile, node, values in zip(*[batch[c].to_pylist() for c in ("root", "tile", "node")], batch["s"], strict=True):
            if held != (root, tile) and sets:
                yield settle()
                nodes, sets = [], []
            held = (root, tile)
            nodes.append(node)
            sets.append(values.values.to_numpy(zero_copy_only=False).view(np.uint64).copy())
    if sets:
        yield settle()


def links(nodes: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", direct: int = DIRECT) -> DataFrame:
    """u, v: links with the same connected components as all near copies among the candidates.

    ``nodes``: node, doc_id (the smallest), n, fp.
    """
    schema = pa.schema([("node", pa.int64()), ("s", pa.list_(pa.int64()))])

    def compute(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([shingles(t.as_py()).view(np.int64) for t in batch["text"]], pa.list_(pa.int64()))], schema=schema)

    # one row of each node: texts are dealt out by node and id, since many rows can have the same text
    none = F.lit(2**63 - 1)
    found = clusters(nodes)
    found = found.union(found.select(F.col("root").alias("node"), "root")).distinct()
    wanted = common.materialize(found.join(nodes.select("node", "n", F.coalesce("doc_id", none).alias("id")), "node"), "near-clusters")
    size = wanted.groupBy("root").agg(F.ceil(F.greatest(F.count("*"), F.sum("n") / EACH) / direct).cast("int").alias("blocks")).where("blocks > 1")
    # a cluster of several blocks is rare: one of more than ``direct`` texts, or of as many shingles
    block = wanted.join(F.broadcast(size), "root", "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
    pair = F.transform(others, lambda x: F.least(x, F.col("block")).cast("long") * F.col("blocks") + F.greatest(x, F.col("block")))
    tiles = block.select("root", "node", F.explode(F.coalesce(pair, F.array(F.lit(0).cast("long")))).alias("tile"))
    body = common.text_column(docs, text)
    rows = docs.select(node_of(body).alias("node"), F.coalesce(common.long_column(docs, doc_id), none).alias("id"), body.alias("text"))
    wanted_text = common.sieve(wanted.select(F.xxhash64("node", "id").alias("hash")))
    rows = rows.where(wanted_text(F.xxhash64("node", "id")))
    texts = rows.join(wanted.select("node", "id"), ["node", "id"], "left_semi").dropDuplicates(["node", "id"]).select("node", "text")
    sets = common.materialize(texts.mapInArrow(common.lean(compute), "node long, s array<long>"), "near-sets")
    dealt = tiles.join(sets, "node").repartition(common.scaled(sets), "root", "tile").sortWithinPartitions("root", "tile")
    out = common.materialize(dealt.mapInArrow(common.lean(verified), "u long, v long").distinct(), "near-links")
    common.discard(sets, wanted)
    return out
