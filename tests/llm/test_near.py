"""SimHash candidates, forests of links and exact groups of near copies."""

import random

import numpy as np
import pyarrow as pa

from tidelog.llm import minhash, near, simhash

from .helpers import rows_of, table


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(w, places, tag):
    return [f"{tag}{k}" if k in places else x for k, x in enumerate(w)]


def jaccard(a, b):
    a, b = (set(minhash.shingles(" ".join(x)).tolist()) for x in (a, b))
    return len(a & b) / len(a | b)


def test_pairs_at_the_limit_share_a_variant_and_are_near():
    """Sets of shingles with a similarity of 0.8 exactly, of many and of few shingles."""
    rng = np.random.default_rng(5)
    for both, left, right in ((160, 20, 20), (16, 2, 2), (8, 1, 1), (4, 0, 1)):
        found = 0
        for _ in range(300):
            h = rng.integers(0, 2**64, both + left + right, np.uint64)
            fps = [near.wide(np.sort(x)) for x in (h[: both + left], np.concatenate([h[:both], h[both + left :]]))]
            raw = [np.frombuffer(f, np.uint8)[None] for f in fps]
            a, b = (near.variants(r[:, 8 * near.CHECK :], 0, near.SEGMENTS) for r in raw)
            bits = np.unpackbits(raw[0][0, : 8 * near.CHECK] ^ raw[1][0, : 8 * near.CHECK]).sum()
            found += bool(np.isin(a, b).any() and bits <= near.RADIUS)
        assert found >= 298


def test_a_key_emits_a_forest():
    """400 near fingerprints under one key and 10 others far from them, in batches: 399 links, not all pairs."""
    rng = np.random.default_rng(6)
    base, rows = rng.integers(0, 2**63, 3), []
    for k in range(400):
        rows.append((1, k, *(int(x) ^ (1 << int(rng.integers(60))) for x in base)))
    rows += [(1, 400 + k, *(int(x) for x in rng.integers(0, 2**63, 3))) for k in range(10)]
    rows += [(2, 500, 0, 0, 0), (2, 501, 1, 0, 0), (3, 502, 0, 0, 0)]
    names = ["key", "label", "a", "b", "c"]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    got = list(near.linked(iter(pa.Table.from_arrays(columns, names).to_batches(max_chunksize=64))))
    links = [(u, v) for b in got for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())]
    assert sorted(links) == [(k, 0) for k in range(1, 400)] + [(501, 500)]


def test_a_crowded_group_keeps_links_between_larger_ids(spark):
    """A text that is near a copy of the smallest text only, not the smallest itself, is in the group."""
    rng = random.Random(9)
    base = words(rng, 200)
    copies = [edited(base, set(rng.sample(range(0, 200, 10), 3)), f"c{k}x") for k in range(40)]
    far = next(f for f in (edited(copies[7], set(rng.sample(range(5, 200, 10), 4)), "f") for _ in range(1000)) if jaccard(f, base) < 0.8 <= jaccard(f, copies[7]) and sum(jaccard(f, c) >= 0.8 for c in copies) == 1)
    assert all(jaccard(c, base) >= 0.8 for c in copies)
    rows = [(0, " ".join(base))] + [(1 + k, " ".join(c)) for k, c in enumerate(copies)] + [(99, " ".join(far))]
    assert [r["doc_id"] for r in rows_of(simhash.keep_one(table(spark, rows), direct=4))] == [0]


def test_links_grow_with_the_group_not_its_square(spark):
    """Near copies of one text, below 0.8 among each other: each of 4 tasks writes one link a text at most, not one a pair."""
    rng = random.Random(12)
    base = words(rng, 200)
    for n in (60, 180):
        rows = [(k, " ".join(edited(base, set(rng.sample(range(0, 200, 10), 4)), f"c{k}x"))) for k in range(n)]
        nodes = near.fingerprints(table(spark, rows), "doc_id", "text").selectExpr("node AS label", "fp")
        links = near.candidates(nodes, 0, near.SEGMENTS, 4)
        assert n - 1 <= links.count() <= 4 * (n - 1)


def test_a_text_is_shuffled_twice_a_segment_and_meets_all_that_share_a_variant():
    """Fingerprints whose first segments differ in one run, in one half or in both; runs of rows go over the batches."""
    rng = np.random.default_rng(7)
    begin, end, ends = 3, 5, 0
    fps = []
    for _ in range(40):
        base = rng.integers(0, 256, 8 * (near.CHECK + near.SEGMENTS * near.BYTES // 8), np.uint8)
        for _ in range(6):
            parts = rng.integers(0, 256, len(base), np.uint8)
            parts[: 8 * near.CHECK] = base[: 8 * near.CHECK]
            for segment in (3, 4):
                places = slice(8 * near.CHECK + near.BYTES * segment, 8 * near.CHECK + near.BYTES * (segment + 1))
                parts[places] = base[places] ^ (rng.integers(0, 16, 3, np.uint8) << rng.choice([0, 4], 3).astype(np.uint8)) * rng.integers(0, 2, 3, np.uint8)
            fps.append(parts.tobytes())
    nodes = pa.table({"label": pa.array(range(len(fps)), pa.int64()), "fp": pa.array(fps, pa.binary())})
    rows = pa.Table.from_batches(list(near.keyed(iter(nodes.to_batches()), begin, end)))
    assert len(rows) == 2 * (end - begin) * len(fps)
    met = near.linked(near.opened(iter(rows.sort_by("key").to_batches(max_chunksize=3))))
    got = [(u, v) for b in met for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())]
    wanted = []
    for u in range(len(fps)):
        for v in range(u):
            apart = [int.from_bytes(x, "big") for x in (bytes(a ^ b for a, b in zip(fps[u][24 + 3 * s : 27 + 3 * s], fps[v][24 + 3 * s : 27 + 3 * s])) for s in (3, 4))]
            shared = any(x & ~(15 << 4 * run) == 0 for x in apart for run in range(near.RUNS))
            ends += not shared
            if shared and fps[u][:24] == fps[v][:24]:
                wanted.append((u, v))
    label = lambda links: near.roots(*np.array(links).T, len(fps)).tolist()
    assert wanted and ends and label(got) == label(wanted)


def test_no_table_but_the_groups_is_left_of_the_nodes(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")) / "tidelog"
    before = set(shared.glob("near-nodes-*"))
    assert simhash.near_groups(table(spark, [(1, "a b c"), (2, "a b c"), (3, "d")])).count() == 2
    assert set(shared.glob("near-nodes-*")) == before
