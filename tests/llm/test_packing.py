import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidelog.llm import packing

from .helpers import rows_of, table

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def expected(rows, capacity):
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check(got, rows, capacity):
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=repr) == expected(rows, capacity)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    return len(places), -(-total // capacity)


ODD = [(1, None), (2, ""), (None, "a b"), (3, "x" * 5000), (4, "İSTANBUL ΣΑΣ <|endoftext|> é b\x1cc d  \t\r\n 12 don't"), (5, " \n "), (5, " \n "), (6, "word " * 3000)]


def test_odd_texts(spark):
    got = rows_of(packing.pack(table(spark, ODD), P.path("word_bpe_49k.json"), capacity=64))
    check(got, ODD, 64)


def test_long_texts_are_encoded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    rows = [(i, f"The quick, brown fox's {i} jumps. " * (i * 7)) for i in range(12)]
    check(rows_of(packing.pack(table(spark, rows), P.path("word_bpe_49k.json"), capacity=32)), rows, 32)


def test_documents_fill_their_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for shard_size, most in ((4096, 1), (40, 3)):  # tiny shards go through several rounds
        bins, least = check(rows_of(packing.pack(docs, P.path("word_bpe_49k.json"), shard_size=shard_size)), rows, 2048)
        assert bins <= least + most


def test_words_take_the_same_ids_as_whole_texts():
    whole, words = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.WordEncoder(P.path("word_bpe_49k.json"))
    every = [chr(c) for c in [*range(33, 1300), 0x1E9E, 0x212A, 0x17F, 0x3A3, 0xFB01, 0x1F600, 0x4E2D, 0xA0, 0x2028, 0x301]]
    for text in [*every, *[f"Ab{c}cD" for c in every], *[f"É{c}'S9{c}{c}'ll" for c in every], "don't we'LL 'tis x'", "A\u0301 é\u0301", "<|endoftext|>é", "İi"]:
        assert words.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def triplets(n, seed):
    """Pieces that fill ``n`` bins of 1000 exactly, three each; best-fit decreasing needs more bins."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(251, (1000 - a) // 2 + 1))
        out += [a, b, 1000 - a - b]
    return out


def best_fit(lengths):
    out = packing.Bins(1000, [], lengths)
    out.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
    return len(out.bins)


def count(assign, lengths):
    fill = np.bincount(assign, weights=lengths)
    assert fill.max() <= 1000 and len(assign) == len(lengths)
    return len(fill)


@pytest.mark.parametrize("seed", range(4))
def test_genetic_search_needs_fewer_bins_than_best_fit(seed):
    lengths = triplets(40, seed)
    found = [count(packing.evolve(lengths, 1000, [], np.random.default_rng(seed), 8, g), lengths) for g in (0, 10, 100)]
    assert found[0] >= found[1] >= found[2] >= 40 and found[2] <= best_fit(lengths) - 2


def test_migration_takes_an_island_further():
    lengths = triplets(40, 9)
    alone = packing.evolve(lengths, 1000, [], np.random.default_rng(1), 4, 3)
    elite = packing.evolve(lengths, 1000, [], np.random.default_rng(2), 8, 200)
    helped = packing.evolve(lengths, 1000, [elite], np.random.default_rng(1), 4, 3)
    assert count(helped, lengths) <= count(elite, lengths) < count(alone, lengths)


def test_islands_and_epochs_of_shards(spark):
    lengths = {shard: triplets(30, 20 + shard) for shard in range(2)}
    items = spark.createDataFrame([(k, n, shard) for shard, own in lengths.items() for k, n in enumerate(own)], "uid long, length long, shard long")
    bins = {}
    for islands, epochs in ((1, 1), (3, 3)):
        got = packing.solve(items, 1000, islands, epochs, 4, 8).collect()
        bins[islands] = {s: min(count(np.frombuffer(bytes(r["assign"]), "<i4"), lengths[s]) for r in got if r["shard"] == s) for s in lengths}
    for shard, own in lengths.items():
        assert bins[3][shard] <= bins[1][shard] < best_fit(own)
    assert sum(bins[3].values()) < sum(bins[1].values())


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 300, 200).tolist()
    parents = []
    for _ in range(2):
        p = packing.Bins(512, [], lengths)
        p.best_fit(rng.permutation(200).tolist())
        parents.append(p)
    child = packing.crossover(*parents, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(200))
    assert all(512 - sum(lengths[i] for i in b) == f >= 0 for b, f in zip(child.bins, child.free))


def test_empty_table(spark):
    assert packing.pack(table(spark, []), P.path("word_bpe_49k.json")).count() == 0
