"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The ids are those of the model file's own library, for unigram and for merge models.  A document of less than ``chunk``
characters is encoded by the library.  A longer one is cut at fixed places, and every chunk is worked on by itself:

1. A state at a cut is the token that ends there or goes across it.  A chunk's transfer matrix holds, for every state at its
   start and at its end, the greatest weight of the ways between them, in the max-plus semiring.  In a
   unigram model a token weighs its score.  A merge model's segmentation is the one in which every two neighbours are
   what merging makes of the two together; there ways weigh 0 if all their neighbours are so, and minus infinity otherwise.
2. The matrices are combined associatively: pairwise in a tree inside blocks of ``BLOCK`` chunks, then over
   a document's blocks.  That fixes the states at the blocks' ends, and inside the blocks those at all cuts.
3. Every chunk is traced back on its own between its two states.

No piece holds a space mark after another character, so that every such place, a word start, is a
node of all segmentations: where a chunk has one, a matrix is the sum of a column up to the first and a row from the last
(what lies between adds the same to all ways), and the words between are the library's.  Only a chunk without a
word start takes the full recurrence.

Decoding joins the pieces, turns space marks into spaces and byte pieces into bytes,
and drops the leading space that encoding adds.

Defined cases: a null or empty text has no tokens; characters without a piece become their UTF-8
bytes; a space mark in a text decodes to a space; rows are encoded each for
itself, repeated ids included, null ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "\u2581"
# Fixed values of the model file.
NORMAL, BYTE = 1, 6
UNIGRAM, MERGES = 1, 2
UNKNOWN_PENALTY = 10.0
NEVER = -np.inf
CACHED_PAIRS = 500_000
#: Documents that a task hands on at a time.
ROWS_AT_ONCE = 256
#: Chunks whose matrices one task combines.
BLOCK = 64


def message(raw: bytes):
    """Fields of a protocol buffer: (number, value)."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = (4, at) if key & 7 == 5 else (8, at) if key & 7 == 1 else number(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """The pieces of a model file, and its library."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.kind = UNIGRAM
        for n, value in message(raw):
            if n == 2:
                self.kind = dict(message(value)).get(3, UNIGRAM)
            if n == 3 and dict(message(value)).get(1, b"identity") != b"identity":
                raise ValueError("texts would be changed before they are encoded")
            if n != 1:
                continue
            item = dict(message(value))
            piece, kind = item[1].decode(), item.get(3, NORMAL)
            if kind == NORMAL:
                self.score[piece], self.id[piece] = struct.unpack("<f", item.get(2, b"\0\0\0\0"))[0], len(self.shown)
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = len(self.shown)
            self.shown.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode() if kind == NORMAL else b"")
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("neither a unigram nor a merge model")
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece spans a word start")
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """A short text by merges: of all neighbours that make a piece those with the best score, the first of several."""
        parts = list(text)
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether a token may follow another one, or begin a word."""
        if self.kind == UNIGRAM:
            return True
        found = self.pairs.get((before, token))
        if found is None:
            found = self.merged((before or "") + token) == ([before] if before else []) + [token]
            if len(self.pairs) < CACHED_PAIRS:
                self.pairs[before, token] = found
        return found

    def weight(self, token: str) -> float:
        return 0.0 if self.kind == MERGES else self.score.get(token, self.unknown)

    def tokens(self, text: str, at: int) -> list[str]:
        """What may start at a place: pieces, and the single character."""
        found = [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1)]
        return [t for t in found if len(t) == 1 or t in self.score]

    def ids(self, tokens: list[str]) -> list[int]:
        out = []
        for token in tokens:
            known = self.id.get(token)
            out += [known] if known is not None else [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str) -> bytes:
        """The library's ids of a text."""
        return array.array("I", self.library.encode(text)).tobytes()

    def decode(self, ids: bytes) -> bytes:
        shown = self.shown
        out = b"".join([shown[i] for i in array.array("I", ids)])
        return out[1:] if out[:1] == b" " else out


def mark(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def word_starts(text: str, low: int, high: int) -> tuple[int, int]:
    """The first and last space mark after another character at a place from ``low`` to ``high`` - 1, or -1."""
    found = re.compile(f"(?<=[^{MARK}]){MARK}").search(text, low, high)
    if not found and not (low and low < high and text[low] == MARK and text[low - 1] != MARK):
        return -1, -1
    first = low if low and text[low] == MARK and text[low - 1] != MARK else found.start()
    last = high
    while True:
        last = text.rfind(MARK, 0, last)
        if text[last - 1] != MARK:
            return first, last


def states_at(v: Vocabulary, text: str, cut: int) -> list[tuple[int, int]]:
    """Characters before and after a cut of the tokens that end there or go across it."""
    out = []
    for before in range(1, min(v.longest, cut) + 1):
        for after in range(min(v.longest - before, len(text) - cut) + 1):
            if before + after == 1 or text[cut - before : cut + after] in v.score:
                out.append((before, after))
    return out


def ways(v: Vocabulary, text: str, start: int, before: str | None, stop: int) -> dict[int, dict[str, tuple[float, str | None]]]:
    """Place -> last token -> (greatest weight, token before it), by tokens that start below ``stop``."""
    nodes: dict[int, dict] = {start: {before: (0.0, None)}}
    for at in range(start, stop):
        here = nodes.get(at)
        if not here:
            continue
        for token in v.tokens(text, at):
            best, source = NEVER, None
            for last, (weight, _) in here.items():
                if weight > best and v.fits(last, token):
                    best, source = weight, last
            if best > NEVER:
                nodes.setdefault(at + len(token), {})[token] = (best + v.weight(token), source)
    return nodes


def trace(nodes: dict, start: int, end: int, token: str | None) -> list[str]:
    """The tokens from ``start`` to ``end``, the last of which is ``token``."""
    out = []
    while end > start:
        out.append(token)
        end, token = end - len(token), nodes[end][token][1]
    return out[::-1]


class Chunk:
    """``size`` characters of a text from the place ``lead`` on, with those that tokens across its ends reach."""

    def __init__(self, v: Vocabulary, text: str, lead: int, size: int):
        self.v, self.text, self.low, self.high = v, text, lead, lead + size
        self.entries: list = states_at(v, text, lead) if lead else [None]
        self.exits = states_at(v, text, self.high)
        self.first, self.last = word_starts(text, self.low, self.high)

    def token(self, state, cut: int) -> str | None:
        return None if state is None else self.text[cut - state[0] : cut + state[1]]

    def start(self, entry) -> int:
        return self.low + (entry[1] if entry else 0)

    def left(self, entry, stop: int) -> dict:
        return ways(self.v, self.text, self.start(entry), self.token(entry, self.low), stop)

    def leave(self, nodes: dict) -> list[float]:
        """The weights of the exits; a token that was there before the chunk is an exit too if it fills the chunk."""
        out = []
        for state in self.exits:
            out.append(nodes.get(self.high + state[1], {}).get(self.token(state, self.high), (NEVER, None))[0])
        return out

    def matrix(self) -> np.ndarray:
        if self.first < 0:
            return np.array([self.leave(self.left(e, self.high)) for e in self.entries]).reshape(len(self.entries), len(self.exits))
        column = [max((w for w, _ in self.left(e, self.first).get(self.first, {}).values()), default=NEVER) for e in self.entries]
        row = self.leave(ways(self.v, self.text, self.last, None, self.high))
        return np.array(column)[:, None] + np.array(row)[None, :]

    def encode(self, s: int, t: int) -> bytes:
        """Ids of the tokens that start in the chunk, between its states."""
        v, entry, exit_ = self.v, self.entries[s], self.exits[t]
        end, token = self.high + exit_[1], self.token(exit_, self.high)
        if self.first < 0:
            nodes = self.left(entry, self.high)
            return array.array("I", v.ids(trace(nodes, self.start(entry), end, token))).tobytes()
        nodes = self.left(entry, self.first)
        final = nodes[self.first]
        out = v.ids(trace(nodes, self.start(entry), self.first, max(final, key=lambda k: final[k][0])))
        if self.last > self.first:
            out += v.library.encode(self.text[self.first + 1 : self.last].replace(MARK, " "))
        nodes = ways(v, self.text, self.last, None, self.high)
        return array.array("I", out + v.ids(trace(nodes, self.last, end, token))).tobytes()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def tree(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of matrices, by pairs of pairs."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def cuts_between(matrices: list[np.ndarray], s: int, t: int) -> list[int]:
    """The states at all cuts of the best way from state ``s`` before the first matrix to ``t`` after the last: the middle is fixed first, then each half."""
    if len(matrices) == 1:
        return [s, t]
    half = len(matrices) // 2
    middle = int(np.argmax(tree(matrices[:half])[s] + tree(matrices[half:])[:, t]))
    return cuts_between(matrices[:half], s, middle) + cuts_between(matrices[half:], middle, t)[1:]


SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("ids", pa.binary())])


def summary(v: Vocabulary, doc_ids, n_chars, ids: list[bytes]) -> pa.RecordBatch:
    cells = [doc_ids, n_chars, [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], [hashlib.sha256(v.decode(i)).hexdigest() for i in ids]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, SUMMARY, strict=True)], schema=SUMMARY)


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", chunk: int = 1 << 16) -> DataFrame:
    """doc_id, n_chars, ids (little-endian 32-bit integers): one row per input row.

    ``vocabulary`` is the path of a model file, the same on every machine.
    """
    short, long = split(docs, doc_id, text, chunk)

    def whole(stream):
        v = Vocabulary(vocabulary)
        for doc_ids, texts in portions(stream):
            cells = [doc_ids, list(map(len, texts)), [v.encode(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, ENCODED, strict=True)], schema=ENCODED)

    return short.mapInArrow(common.lean(whole), "doc_id long, n_chars long, ids binary").unionByName(scanned(long, vocabulary, chunk))


def split(docs: DataFrame, doc_id: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Documents of one chunk, and longer ones."""
    body = F.coalesce(common.text_column(docs, text), F.lit(""))
    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), body.alias("text"))
    return rows.where(F.length("text") < chunk), rows.where(F.length("text") >= chunk)


def portions(stream):
    for batch in stream:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part["doc_id"].to_pylist(), part["text"].to_pylist()


def packed(m: np.ndarray) -> bytes:
    return struct.pack("<i", m.shape[1]) + m.astype("<f8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    (width,) = struct.unpack_from("<i", raw)
    return np.frombuffer(raw, "<f8", offset=4).reshape(-1, width)


def scanned(long: DataFrame, vocabulary: str, chunk: int) -> DataFrame:
    """The long documents' ids by the parallel scan."""
    chunks = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("chunk", pa.int32()), ("lead", pa.int32()), ("size", pa.int32()), ("text", pa.string())])
    columns = "row string, doc_id long, n_chars long, chunk int, lead int, size int, text string"

    def deal(stream):
        import uuid

        reach = Vocabulary(vocabulary).longest
        if chunk < 2 * reach:
            raise ValueError("a chunk must be longer than two tokens")
        for batch in stream:
            for ident, body in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                body, row = body.as_py(), uuid.uuid4().hex
                marked = mark(body)
                for k, at in enumerate(range(0, len(marked), chunk)):
                    lead = min(at, 2 * reach)
                    cells = (row, ident, len(body), k, lead, min(chunk, len(marked) - at), marked[at - lead : at + chunk + reach])
                    yield common.batches({n: [c] for n, c in zip(chunks.names, cells, strict=True)}, chunks)

    parts = common.materialize(long.mapInArrow(common.lean(deal), columns), "pieces-chunks")

    def measure(stream):
        v = Vocabulary(vocabulary)
        for batch in stream:
            found = [packed(Chunk(v, *cells).matrix()) for cells in zip(*[batch[c].to_pylist() for c in ("text", "lead", "size")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["chunk"], pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])

    matrices = common.materialize(parts.select("row", "chunk", "lead", "size", "text").mapInArrow(common.lean(measure), "row string, chunk int, matrix binary"), "pieces-matrices")
    blocks = matrices.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int"))

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        return pa.table({"row": table["row"].slice(0, 1), "block": table["block"].slice(0, 1), "matrix": pa.array([packed(tree([unpacked(m) for m in table["matrix"].to_pylist()]))], pa.binary())})

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        found = [unpacked(m) for m in table["matrix"].to_pylist()]
        cuts = cuts_between(found, 0, int(np.argmax(tree(found)[0])))
        return pa.table({"row": table["row"], "block": table["block"], "s": pa.array(cuts[:-1], pa.int32()), "t": pa.array(cuts[1:], pa.int32())})

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        cuts = cuts_between([unpacked(m) for m in table["matrix"].to_pylist()], table["s"][0].as_py(), table["t"][0].as_py())
        return pa.table({"row": table["row"], "chunk": table["chunk"], "s": pa.array(cuts[:-1], pa.int32()), "t": pa.array(cuts[1:], pa.int32())})

    combined = blocks.groupBy("row", "block").applyInArrow(product, "row string, block int, matrix binary")
    ends = combined.groupBy("row").applyInArrow(between, "row string, block int, s int, t int")
    states = blocks.join(ends, ["row", "block"]).groupBy("row", "block").applyInArrow(inside, "row string, chunk int, s int, t int")

    def traced(stream):
        v = Vocabulary(vocabulary)
        for batch in stream:
            found = [Chunk(v, text, lead, size).encode(s, t) for text, lead, size, s, t in zip(*[batch[c].to_pylist() for c in ("text", "lead", "size", "s", "t")], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("row", "doc_id", "n_chars", "chunk")], pa.array(found, pa.binary())], names=["row", "doc_id", "n_chars", "chunk", "ids"])

    ids = parts.join(states, ["row", "chunk"]).select("row", "doc_id", "n_chars", "chunk", "lead", "text", "size", "s", "t").mapInArrow(common.lean(traced), "row string, doc_id long, n_chars long, chunk int, ids binary")

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "n_chars": table["n_chars"].slice(0, 1), "ids": pa.array([b"".join(table["ids"].to_pylist())], pa.binary())})

    return ids.groupBy("row").applyInArrow(gather, "doc_id long, n_chars long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids."""

    def run(stream):
        v = Vocabulary(vocabulary)
        for batch in stream:
            texts = [v.decode(i.as_py()).decode("utf-8", "replace") for i in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(common.lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", chunk: int = 1 << 16) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32, decoded_sha256: every text encoded and decoded again."""
    short, long = split(docs, doc_id, text, chunk)

    def whole(stream):
        v = Vocabulary(vocabulary)
        for doc_ids, texts in portions(stream):
            yield summary(v, doc_ids, list(map(len, texts)), [v.encode(t) for t in texts])

    def parts(stream):
        v = Vocabulary(vocabulary)
        for batch in stream:
            yield summary(v, batch["doc_id"].to_pylist(), batch["n_chars"].to_pylist(), batch["ids"].to_pylist())

    schema = "doc_id long, n_chars long, n_tokens long, ids_crc32 long, decoded_sha256 string"
    return short.mapInArrow(common.lean(whole), schema).unionByName(scanned(long, vocabulary, chunk).mapInArrow(common.lean(parts), schema))
