"""Exact substring deduplication with fixed-block anchors.

A word is removed when a window of ``window`` consecutive words covering it also
starts in a document with a smaller id.  Any such window holds, in the other document,
a whole reference block: blocks are the non-overlapping runs of ``window // 2`` words.

1. Index and probe.  Every document contributes its blocks to the index and every
   rolling window of the block's length as a probe.  Hashes meet in buckets: a probe is a
   hit if a smaller document has the block, and a block is a hit if a larger one probes it.
   Hashes are packed by bucket (6 bytes each, document ids once per run), so
   that what is shuffled is about one value per word.
2. Extend.  Around every hit, the windows that contain it are formed in both documents
   and compared by BLAKE2 digests (128 bits) of their words; the smallest document of each digest
   keeps it, and every other one has a verified repeat.  Repeated windows that follow or overlap each
   other join into maximal exact repeats (``maximal_repeats``).
3. Remove.  The windows' starts come back to each document, and the words they cover go.

Hot blocks and windows: a map task looks at about a million words at a time; what
several documents among them share is settled there, so each task sends one
message for a hash or digest however many of its documents hold it.  Windows are dealt out by the smallest block
hash in them, which keeps neighbours together; where a sample of the documents shows one such hash in
more windows than a quarter of a bucket should hold, those windows are dealt out by their own digests.  There are at
most four times as many such hashes as buckets, and buckets follow the size of the input.

Defined cases: a null text has no words; a null doc_id counts as larger than every id (like the id 2^63 - 1), and rows
without id are told apart by their texts; rows with the same id never remove words from each other; repeated rows get equal results;
documents below ``window`` words stay whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LAST = 2**63 - 1
#: One in so many documents is looked at for hashes that many windows are dealt out by; fewer than ``RARE`` sampled windows are not many.
SAMPLED, RARE = 16, 256
#: Positions that a map task sorts at a time.
FLUSH = 600_000
MASK = np.uint64((1 << 48) - 1)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split(): \x20 and \x09-\x0D


def rolling(words: list[bytes], n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    power, size = np.frombuffer(b"".join([digest(w) for w in words]), "<u8"), 1
    out, done = None, 0
    while True:
        if n & size:
            piece = power[done : done + len(words) - n + 1]
            out = piece if out is None else common.mix(out * np.uint64(0x9FB21C651E98DF25) + piece)
            done += size
        if size * 2 > n:
            return out.copy()
        power = common.mix(power[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:])
        size *= 2


def to6(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


ANCHORS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
INDEX, PROBE, ASK, SURE = 0, 1, 2, 3


class Packer:
    """Collects (kind, hash, id, mark) and packs them by bucket, grouped by document; a mark of 0 wants no answer."""

    def __init__(self, buckets: int):
        self.buckets, self.rows = buckets, {f.name: [] for f in ANCHORS}

    def add(self, kind: int, h: np.ndarray, ids: np.ndarray, marks: np.ndarray | None = None) -> None:
        marks = np.zeros(len(h), np.int64) if marks is None else marks
        where = bucket_of(h, self.buckets) if kind != SURE else np.abs(ids ^ marks) % self.buckets
        order = np.lexsort((marks, ids, where))
        h, ids, marks, where = h[order], ids[order], marks[order], where[order]
        cut = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(h)).tolist(), strict=True):
            if a == b:
                continue
            at = np.flatnonzero(np.concatenate([[True], (ids[a + 1 : b] != ids[a : b - 1]) | (marks[a + 1 : b] != marks[a : b - 1])]))
            self.rows["bucket"].append(int(where[a]))
            self.rows["kind"].append(kind)
            self.rows["ids"].append(ids[a:b][at].astype("<i8").tobytes())
            self.rows["marks"].append(marks[a:b][at].astype("<i8").tobytes())
            self.rows["counts"].append(np.diff(np.append(at, b - a)).astype("<u4").tobytes())
            self.rows["hashes"].append(to6(h[a:b]))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, {f.name: [] for f in ANCHORS}
        return common.batches(rows, ANCHORS)


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.frombuffer(row["counts"], "<u4")
    return from6(row["hashes"]), np.repeat(np.frombuffer(row["ids"], "<i8"), counts), np.repeat(np.frombuffer(row["marks"], "<i8"), counts)


def settle(h: np.ndarray, ids: np.ndarray, marks: np.ndarray, aligned: np.ndarray, packer: Packer) -> None:
    """Packs one map-side group: one message a hash, and what the group settles itself."""
    order = np.argsort(h, kind="stable")  # a document's equal hashes stay next to each other
    h, ids, marks, aligned = h[order], ids[order], marks[order], aligned[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.flatnonzero(first)
    low, high = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
    low_block = np.minimum.reduceat(np.where(aligned, ids, LAST), start)
    has_block = np.logical_or.reduceat(aligned, start)
    shared = low < high
    packer.add(INDEX, h[start][has_block], low_block[has_block])
    packer.add(PROBE, h[start][shared], high[shared])
    group = np.cumsum(first) - 1
    once = first | np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    alone = once & ~shared[group]
    packer.add(PROBE, h[alone], ids[alone], marks[alone])
    alone &= has_block[group]
    packer.add(ASK, h[alone], ids[alone], marks[alone])
    sure = once & shared[group]
    packer.add(SURE, h[sure], ids[sure], marks[sure])


def anchor_rows(stream, block: int, window: int, buckets: int):
    packer, held, size = Packer(buckets), [], 0

    def flush():
        settle(*(np.concatenate(x) for x in zip(*held, strict=True)), packer)
        held.clear()
        return packer.take()

    for batch in stream:
        for key, mark, text in zip(batch["key"].to_pylist(), batch["mark"].to_pylist(), batch["text"], strict=True):
            words = split_words(text.as_py())
            if len(words) < window:
                continue
            h = rolling(words, block)
            # pieces keep memory bounded for texts of any length
            for at in range(0, len(h), FLUSH):
                part = h[at : at + FLUSH]
                held.append((part, np.full(len(part), key, np.int64), np.full(len(part), mark, np.int64), (np.arange(at, at + len(part)) % block) == 0))
                size += len(part)
                if size >= FLUSH:
                    yield flush()
                    size = 0
    if held:
        yield flush()


HITS = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("hashes", pa.binary())])


def by_document(h: np.ndarray, ids: np.ndarray, marks: np.ndarray, out: dict[str, list]) -> None:
    """Rows (id, mark, packed hashes)."""
    order = np.lexsort((marks, ids))
    h, ids, marks = h[order], ids[order], marks[order]
    cut = np.flatnonzero((np.diff(ids) != 0) | (np.diff(marks) != 0)) + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(ids)).tolist(), strict=True):
        if a < b:
            out["key"].append(int(ids[a]))
            out["mark"].append(int(marks[a]))
            out["hashes"].append(to6(np.unique(h[a:b])))


def match_anchors(stream):
    """Rows sorted by (bucket, kind): the index is built, probed, and asked which of its blocks were hit."""
    bucket, known, low, high = None, None, None, None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def build():
        h, ids = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        waiting.clear()
        return h[start], (np.minimum.reduceat(ids, start) if len(h) else ids), np.full(len(start), -(2**63), np.int64)

    for batch in stream:
        out = {f.name: [] for f in HITS}
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                bucket, known = row["bucket"], None
                waiting.clear()
            h, ids, marks = unpack(row)
            if row["kind"] == INDEX:
                waiting.append((h, ids))
                if len(waiting) >= 64:  # one entry a hash is enough
                    h, ids, _ = build()
                    waiting.append((h, ids))
                continue
            if row["kind"] == SURE:
                by_document(h, ids, marks, out)
                continue
            if known is None:
                known, low, high = build()
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            there = known[at] == h
            if row["kind"] == PROBE:
                np.maximum.at(high, at[there], ids[there])
                hit = there & (low[at] < ids) & (marks != 0)
            else:
                hit = there & (high[at] > ids)
            by_document(h[hit], ids[hit], marks[hit], out)
        if out["key"]:
            yield common.batches(out, HITS)


WINDOWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("texts", pa.binary()), ("starts", pa.binary()), ("digests", pa.binary())])
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def windows_of(words: list[bytes], anchors: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that hold an anchor, and the smallest hash of a run of ``block`` words in each.

    Windows next to each other mostly share that hash, so that what is dealt out by it stays in few pieces.
    """
    n = len(words) - window + 1
    h = rolling(words, block)
    total = np.concatenate([[0], np.cumsum(np.isin(h & MASK, anchors))])
    starts = np.arange(n)
    low, size, runs = h, 1, window - block + 1
    while size * 2 <= runs:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[:n], low[runs - size : runs - size + n])
    some = total[starts + runs] > total[starts]
    return starts[some], low[some]


def window_rows(stream, block: int, window: int, buckets: int, hot: np.ndarray):
    """Digests of candidate windows; what a map-side group settles itself is a removal at once."""
    held: list[tuple] = []
    size = 0

    def flush():
        digests, ids, texts, starts, dealt = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, digests["b"], digests["a"]))
        digests, ids, texts, starts, dealt = digests[order], ids[order], texts[order], starts[order], dealt[order]
        first = np.concatenate([[True], digests[1:] != digests[:-1]])
        low = ids[first][np.cumsum(first) - 1]
        rows = {f.name: [] for f in WINDOWS}
        where = bucket_of(common.mix(np.where(np.isin(dealt, hot), digests["a"], dealt)), buckets)
        for kind, some in ((1, ids > low), (0, ids == low)):
            # of the smallest document's windows all ask: each of its rows and places may be removed
            at = np.flatnonzero(some)
            spread = where[at] if kind == 0 else np.abs(texts[at]) % buckets
            at, spread = at[np.argsort(spread, kind="stable")], np.sort(spread, kind="stable")
            cut = np.flatnonzero(np.diff(spread)) + 1
            for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(at)).tolist(), strict=True):
                if a < b:
                    part = at[a:b]
                    rows["bucket"].append(int(spread[a]))
                    rows["kind"].append(kind)
                    rows["ids"].append(ids[part].astype("<i8").tobytes())
                    rows["texts"].append(texts[part].astype("<i8").tobytes())
                    rows["starts"].append(starts[part].astype("<i8").tobytes())
                    rows["digests"].append(digests[part].tobytes() if kind == 0 else b"")
        held.clear()
        return common.batches(rows, WINDOWS)

    for batch in stream:
        for key, mark, text, hits in zip(batch["key"].to_pylist(), batch["mark"].to_pylist(), batch["text"], batch["hits"].to_pylist(), strict=True):
            words = split_words(text.as_py())
            if len(words) < window:
                continue
            starts, least = windows_of(words, from6(b"".join(hits)), block, window)
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            for at in range(0, len(starts), FLUSH // 4):
                part = starts[at : at + FLUSH // 4]
                digest = hashlib.blake2b
                d = np.frombuffer(b"".join([digest(line[a:b], digest_size=16).digest() for a, b in zip(begins[part].tolist(), ends[part + window - 1].tolist(), strict=True)]), PAIR)
                held.append((d, np.full(len(d), key, np.int64), np.full(len(d), mark, np.int64), part, least[at : at + FLUSH // 4]))
                size += len(d)
                if size >= FLUSH // 4:
                    yield flush()
                    size = 0
    if held:
        yield flush()


def count_windows(stream, block: int, window: int):
    """(smallest hash, windows): how many candidate windows are dealt out by each."""
    held: list[np.ndarray] = []

    def flush():
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["least", "n"])

    for batch in stream:
        for text, hits in zip(batch["text"], batch["hits"].to_pylist(), strict=True):
            words = split_words(text.as_py())
            if len(words) >= window:
                held.append(windows_of(words, from6(b"".join(hits)), block, window)[1])
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
    if held:
        yield flush()


def hot_hashes(candidates: DataFrame, block: int, window: int, buckets: int) -> np.ndarray:
    """Smallest hashes that hold more windows than a quarter of a bucket should, from one in ``SAMPLED`` documents; at most 4 x buckets."""
    sample = candidates.where(F.pmod(F.xxhash64("key", "mark", F.lit("hot")), F.lit(SAMPLED)) == 0).select("text", "hits")
    counts = sample.mapInArrow(common.lean(lambda s: count_windows(s, block, window)), "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    counts = common.materialize(counts, "substring-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("n") > max(RARE, total / (4 * buckets))).select("least").collect()
    common.discard(counts)
    return np.array([r["least"] for r in found], np.int64).view(np.uint64)


FOUND = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("starts", pa.binary())])


def settle_windows(stream):
    """Rows sorted by bucket -> (key, mark, starts of the windows to remove)."""

    def emit(ids, texts, starts, out):
        order = np.lexsort((starts, texts, ids))
        ids, texts, starts = ids[order], texts[order], starts[order]
        cut = np.flatnonzero((np.diff(ids) != 0) | (np.diff(texts) != 0)) + 1
        for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(ids)).tolist(), strict=True):
            if a < b:
                out["key"].append(int(ids[a]))
                out["mark"].append(int(texts[a]))
                out["starts"].append(starts[a:b].astype("<i8").tobytes())

    bucket, waiting = None, []

    def done(out):
        if waiting:
            digests, ids, texts, starts = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.lexsort((ids, digests["b"], digests["a"]))
            digests, ids, texts, starts = digests[order], ids[order], texts[order], starts[order]
            first = np.concatenate([[True], digests[1:] != digests[:-1]])
            again = ids > ids[first][np.cumsum(first) - 1]
            emit(ids[again], texts[again], starts[again], out)
            waiting.clear()

    for batch in stream:
        out = {f.name: [] for f in FOUND}
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                done(out)
                bucket = row["bucket"]
            ids, texts, starts = (np.frombuffer(row[c], "<i8") for c in ("ids", "texts", "starts"))
            if row["kind"]:
                emit(ids, texts, starts, out)
            else:
                waiting.append((np.frombuffer(row["digests"], PAIR), ids, texts, starts))
        yield common.batches(out, FOUND)
    out = {f.name: [] for f in FOUND}
    done(out)
    yield common.batches(out, FOUND)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """key, mark, starts: the starts of repeated windows of each (id, text hash) that has any."""
    block, buckets = window // 2, common.scaled(docs)
    body = common.text_column(docs, text)
    rows = docs.select(F.coalesce(common.long_column(docs, doc_id), F.lit(LAST)).alias("key"), F.xxhash64(body).alias("mark"), body.alias("text")).where("text is not null")
    packed = rows.mapInArrow(common.lean(lambda s: anchor_rows(s, block, window, buckets)), "bucket int, kind int, ids binary, marks binary, counts binary, hashes binary")
    hits = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(common.lean(match_anchors), "key long, mark long, hashes binary")
    hits = common.materialize(hits, "substring-hits")
    grouped = hits.groupBy("key", "mark").agg(F.collect_list("hashes").alias("hits"))
    candidates = rows.join(grouped, ["key", "mark"]).select("key", "mark", "text", "hits")
    hot = hot_hashes(candidates, block, window, buckets)
    asked = candidates.mapInArrow(common.lean(lambda s: window_rows(s, block, window, buckets, hot)), "bucket int, kind int, ids binary, texts binary, starts binary, digests binary")
    found = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(settle_windows), "key long, mark long, starts binary")
    found = common.materialize(found, "substring-windows")
    common.discard(hits)
    return found


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:n]) > 0


def with_repeats(docs: DataFrame, doc_id: str, text: str, window: int, starts: str) -> DataFrame:
    """The documents with a column ``starts`` (array of binaries, null where nothing repeats)."""
    found = repeats(docs, doc_id, text, window)
    key, mark = common.unused(docs, "key", "mark")
    by_doc = found.groupBy("key", "mark").agg(F.collect_list("starts").alias(starts)).withColumnsRenamed({"key": key, "mark": mark})
    keyed = docs.withColumns({key: F.coalesce(common.long_column(docs, doc_id), F.lit(LAST)), mark: F.xxhash64(common.text_column(docs, text))})
    return keyed.join(by_doc, [key, mark], "left").drop(key, mark)


def removed(text: str | None, starts: list[bytes] | None, window: int) -> tuple[list[bytes], np.ndarray]:
    words = split_words(text)
    at = np.frombuffer(b"".join(starts or []), "<i8")
    return words, covered(len(words), at, window)


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """doc_id, start, end: the word ranges (end exclusive) of every row that windows of a smaller document cover, as long as they go."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(stream):
        for batch in stream:
            out = {f.name: [] for f in schema}
            for ident, body, starts in zip(batch["doc_id"].to_pylist(), batch["text"], batch["starts"].to_pylist(), strict=True):
                if starts:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], removed(body.as_py(), starts, window)[1], [False]]).astype(int)))
                    out["doc_id"] += [ident] * (len(edges) // 2)
                    out["start"] += edges[::2].tolist()
                    out["end"] += edges[1::2].tolist()
            yield common.batches(out, schema)

    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))
    return with_repeats(rows, "doc_id", "text", window, "starts").select("doc_id", "text", "starts").mapInArrow(common.lean(run), "doc_id long, start long, end long")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space): one row per input row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))

    def summarize(stream):
        for batch in stream:
            out = {f.name: [] for f in schema}
            for ident, body, starts in zip(batch["doc_id"].to_pylist(), batch["text"], batch["starts"].to_pylist(), strict=True):
                words, gone = removed(body.as_py(), starts, window)
                kept = words if not starts else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out["doc_id"].append(ident)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield common.batches(out, schema)

    joined = with_repeats(rows, "doc_id", "text", window, "starts").select("doc_id", "text", "starts")
    return joined.mapInArrow(common.lean(summarize), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """The documents with repeated words cut out of ``text``, other columns unchanged.

    A text without repeats stays as it is; of one with repeats the kept words are joined by
    one space; a document of which nothing is left goes.
    """
    (starts,) = common.unused(docs, "starts")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for body, at in zip(texts, found.to_pylist(), strict=True):
            body = body.as_py()
            if at:
                words, gone = removed(body, at, window)
                body = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass")
            out.append(body)
        return pa.array(out, pa.string())

    marked = with_repeats(docs, doc_id, text, window, starts)
    left = marked.withColumn(text, cut(F.col(f"`{text}`"), F.col(starts)))
    gone = F.col(starts).isNotNull() & (F.length(F.col(f"`{text}`")) == 0)
    return left.where(~gone).select(*[F.col(f"`{c}`") for c in docs.columns])
