"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised whole; only those longer than a sequence are cut.  The pieces
are dealt at random into shards of bounded size.  A shard is solved by several islands, each a task of its
own with its own random numbers.  An individual is a list of bins.  Crossover injects whole
well-filled bins of one parent into the other, drops the bins that hold one of the injected
pieces twice, lets displaced pieces take the places of smaller ones where that fills a bin better, and best-fits
the rest.  Between epochs each island
sends its elite to the next one.  A search ends early when no packing can have fewer bins.  The best individual of a shard closes its
well-filled bins; the pieces of the others are pooled over all shards and
packed in another round.  Rounds go on until the pieces left fit one shard or a round closes bins for less than 30 %
of them, so that their number falls geometrically and there is no cap on rounds.

Defined cases: a null or empty text is one piece of the end token alone; repeated rows are packed
each for itself; null ids are kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = 0
#: Texts are tokenised in parts of about so many characters, cut at white space.
PART = 1 << 20
CACHED_WORDS = 350_000
CACHED_LENGTH = 64
#: Words of printable ASCII and Latin-1 letters, and the pre-tokens of the vocabulary file for them in lower case.
PLAIN = r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*"
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def latin_bytes() -> dict[int, str]:
    """Letters of Latin-1 as the byte-level alphabet writes their two UTF-8 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder(dict):
    """Token ids of texts, as little-endian 32-bit integers: a dictionary from words to ids.

    The tokenizer's pre-tokens never span white space, so that a text's ids are its
    words' ids in a row; words seen before are kept while there is room.  A new word of
    ASCII and Latin-1 letters goes straight to the merge model, after the lower-casing and
    splitting that the vocabulary file asks for; any other takes the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.split = self.tokenizer.model.tokenize, re.compile(PRETOKENS).findall
        self.plain, self.latin = re.compile(PLAIN).fullmatch, latin_bytes()

    def __missing__(self, word: str) -> bytes:
        if self.plain(word) and "<|" not in word:
            parts = self.split(word.lower())
            if not word.isascii():
                parts = [p.translate(self.latin) for p in parts]
            ids = [t.id for p in parts for t in self.merge(p)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        raw = array.array("I", ids).tobytes()
        if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = raw
        return raw

    def encode(self, part: str) -> bytes:
        if "<|" not in part and part == part.encode("latin-1", "ignore").decode("latin-1"):
            part = part.lower()  # letter by letter here, as the tokenizer does it; fewer words to learn
        return b"".join(map(self.__getitem__, part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    def parts(self, text: str):
        """(ids of a part, is the last part) of a text."""
        at = 0
        while True:
            end = len(text) if at + PART >= len(text) else text.find(" ", at + PART)
            end = len(text) if end < 0 else end
            yield self.encode(text[at:end]), end == len(text)
            at = end
            if at == len(text):
                return


def cut(parts, capacity: int):
    """(start, length, crc32) of a document's pieces, from its ids part by part; the end token is its last id."""
    held, start, size = b"", 0, 4 * capacity
    for part, last in parts:
        held += part + (END.to_bytes(4, "little") if last else b"")
        at = 0
        while len(held) - at > size or last and at < len(held):
            piece = held[at : at + size]
            yield start, len(piece) // 4, zlib.crc32(piece)
            start, at = start + capacity, at + size
        held = held[at:]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("uid", pa.int64())])

    def tokenise(stream):
        encoder, counter = WordEncoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in stream:
            out = {f.name: [] for f in schema}
            for ident, text_ in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                for piece, (start, length, crc) in enumerate(cut(encoder.parts(text_.as_py() or ""), capacity)):
                    for name, value in zip(schema.names, (ident, piece, start, length, crc, counter), strict=True):
                        out[name].append(value)
                    counter += 1
            yield common.batches(out, schema)

    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))
    return rows.mapInArrow(common.lean(tokenise), PIECES)


class Bins:
    """Bins by free space; the fullest that still takes a piece is found from a bit mask."""

    def __init__(self, capacity: int, bins: list[list[int]], lengths: list[int]):
        self.capacity, self.bins, self.lengths = capacity, bins, lengths
        self.free = [capacity - sum([lengths[i] for i in b]) for b in bins]
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for k, f in enumerate(self.free):
            self.at[f].append(k)
            self.mask |= 1 << f

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            need = self.lengths[i]
            room = self.mask >> need
            if room:
                f = need + (room & -room).bit_length() - 1
                k = self.at[f].pop()
                if not self.at[f]:
                    self.mask ^= 1 << f
                self.bins[k].append(i)
            else:
                f, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.free.append(f)
            f -= need
            self.free[k] = f
            self.at[f].append(k)
            self.mask |= 1 << f


def value(free: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven ones."""
    used = 1 - np.array(free) / capacity
    return -len(free), float((used * used).mean()) if len(free) else 0.0


def traded(bins: list[list[int]], items: list[int], capacity: int, lengths: np.ndarray) -> list[int]:
    """Displaced pieces take the places of smaller ones where that fills a bin better; returns what is displaced then."""
    where = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    held = np.array([i for b in bins for i in b], np.int64)
    if not len(held):
        return items
    free = capacity - np.bincount(where, weights=lengths[held], minlength=len(bins)).astype(np.int64)
    left = []
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        room = free[where] + lengths[held] - lengths[i]  # what would be free with the piece in place of another
        gain = np.where((room >= 0) & (lengths[held] < lengths[i]), room, capacity)
        k = int(gain.argmin())
        if gain[k] < capacity:
            old, b = int(held[k]), int(where[k])
            bins[b][bins[b].index(old)] = i
            free[b], held[k] = room[k], i
            left.append(old)
        else:
            left.append(i)
    return left


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    full = np.argsort(np.array(b.free), kind="stable")[: max(1, len(b.bins) // 2)]
    donors = rng.choice(full, max(1, int(len(full) * rng.uniform(0.1, 0.6))), replace=False)
    child = [list(b.bins[k]) for k in donors]
    injected = {i for group in child for i in group}
    worst = set(np.argsort(-np.array(a.free) + rng.uniform(0, 8, len(a.free)), kind="stable")[: max(1, len(a.bins) // 50)].tolist())
    displaced = []
    for k, group in enumerate(a.bins):
        if k not in worst and injected.isdisjoint(group):
            child.append(list(group))
        else:
            displaced += [i for i in group if i not in injected]
    displaced = traded(child, displaced, a.capacity, np.array(a.lengths))
    out = Bins(a.capacity, child, a.lengths)
    displaced.sort(key=lambda i: (-a.lengths[i], i))
    out.best_fit(displaced)
    return out


def evolve(lengths: list[int], capacity: int, elites: list[np.ndarray], rng: np.random.Generator, population: int, generations: int) -> np.ndarray:
    """The best individual found: the bin of every piece."""

    def filled(order: list[int]) -> Bins:
        out = Bins(capacity, [], lengths)
        out.best_fit(order)
        return out

    size = np.array(lengths)
    people = []
    for assign in elites:
        groups: list[list[int]] = [[] for _ in range(int(assign.max()) + 1)]
        for i, k in enumerate(assign.tolist()):
            groups[k].append(i)
        people.append(Bins(capacity, groups, lengths))
    while len(people) < population:
        noise = rng.uniform(0, 0.1 * len(people), len(size))
        people.append(filled(np.argsort(-size * (1 + noise), kind="stable").tolist()))
    least = -(-int(size.sum()) // capacity)
    people = sorted(people, key=lambda p: value(p.free, capacity), reverse=True)[:population]
    for _ in range(generations):
        if len(people[0].bins) <= least or len(people) < 2:
            break  # no packing has fewer bins
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(people[a], people[b], rng)
        worth = value(child.free, capacity)
        if all(value(p.free, capacity) != worth for p in people):  # one of equal individuals is enough
            people.append(child)
            people = sorted(people, key=lambda p: value(p.free, capacity), reverse=True)[:population]
    assign = np.zeros(len(lengths), np.int32)
    for k, group in enumerate(people[0].bins):
        assign[group] = k
    return assign


def solve(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """items: uid, length, shard -> (shard, assign), the best of each shard's islands."""
    schema = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("uid", pa.int64()), ("length", pa.int64()), ("assign", pa.binary())])
    text = "shard long, island int, uid long, length long, assign binary"

    def island(epoch: int):
        def run(table: pa.Table) -> pa.Table:
            own = table.filter(table["assign"].is_null()).sort_by("uid")
            elites = sorted(table["assign"].drop_null().to_pylist())
            shard, place = table["shard"][0].as_py(), table["island"][0].as_py()
            rng = np.random.default_rng([shard, place, epoch])
            best = evolve(own["length"].to_pylist(), capacity, [np.frombuffer(e, "<i4") for e in elites], rng, population, generations)
            targets = sorted({place, (place + 1) % islands})
            rows = {"shard": [shard] * len(targets), "island": targets, "uid": [None] * len(targets), "length": [None] * len(targets), "assign": [best.astype("<i4").tobytes()] * len(targets)}
            return pa.Table.from_batches([common.batches(rows, schema)])

        return run

    dealt = items.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uid", "length", F.lit(None).cast("binary").alias("assign"))
    elites = None
    for epoch in range(epochs):
        before, rows = elites, dealt if elites is None else dealt.unionByName(elites)
        elites = common.materialize(rows.groupBy("shard", "island").applyInArrow(island(epoch), text), f"packing-epoch-{epoch}")
        if before is not None:
            common.discard(before)
    return elites.select("shard", "assign").distinct()


PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("uid", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def place(items: DataFrame, best: DataFrame, capacity: int, round_: int, slack: int) -> DataFrame:
    """Every piece with its sequence and offset; ``open`` marks bins with more than ``slack`` free tokens."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(table["assign"].is_null()).sort_by("uid")
        length = own["length"].to_numpy()
        found = []
        for raw in sorted(table["assign"].drop_null().to_pylist()):
            assign = np.frombuffer(raw, "<i4")
            fill = np.bincount(assign, weights=length, minlength=int(assign.max()) + 1).astype(np.int64)
            found.append((value((capacity - fill).tolist(), capacity), raw, assign, fill))
        _, _, assign, fill = max(found, key=lambda x: (x[0], x[1]))
        order = np.argsort(assign, kind="stable")
        total = np.cumsum(length[order]) - length[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(assign[order])) + 1])
        base = np.repeat(total[first], np.diff(np.append(first, len(order))))
        offset = np.zeros(len(order), np.int64)
        offset[order] = total - base
        shard = table["shard"][0].as_py()
        own = own.drop_columns(["shard", "assign"])
        own = own.append_column("sequence_id", pa.array(((round_ << 52) | (shard << 16)) + assign.astype(np.int64)))
        return own.append_column("offset", pa.array(offset)).append_column("open", pa.array((capacity - fill)[assign] > slack)).cast(PLACED)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
    rows = items.select("shard", *names, F.lit(None).cast("binary").alias("assign")).unionByName(best, allowMissingColumns=True)
    return rows.groupBy("shard").applyInArrow(run, f"{PIECES}, sequence_id long, offset long, open boolean")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_size: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    population: int = 4,
    generations: int = 10,
    slack: int = 16,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    ``tokenizer`` is the path of a vocabulary file, the same on every machine.
    """
    placed, round_ = None, 0
    pool = common.materialize(pieces(docs, tokenizer, capacity, doc_id, text), "packing-pieces")
    left = pool.count()
    while True:
        shards = max(1, -(-left // shard_size))
        items = pool.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(shards)))
        best = solve(items, capacity, islands, epochs, population, generations)
        done = common.materialize(place(items, best, capacity, round_, slack), f"packing-round-{round_}")
        still = done.where("open").count() if shards > 1 else 0
        last = not still or still > 0.7 * left
        closed = done if last else done.where("not open")
        placed = closed if placed is None else placed.unionByName(closed)
        if last:
            return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        pool, left, round_ = done.where("open").select(*pool.columns), still, round_ + 1
