import random

import numpy as np
import pytest
import xxhash

from tidelog.llm import graph, simhash

from .helpers import rows_of, table


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps, bits=3):
    """Smallest index reachable, for every index."""
    label = list(range(len(fps)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(fps))]
        changed, label = new != label, new
    return label


def test_fingerprints_and_components(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "One two"), (906, "A B C É d"), (907, "x " * 20_000), (907, "x " * 20_000)]
    got = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(table(spark, rows)))}
    assert all(int(got[i]["fingerprint"], 16) == plain(t) for i, t in rows)
    want = classes(np.array([plain(t) for _, t in rows], np.uint64))
    smallest = {}
    for (i, _), c in zip(rows, want):
        smallest[c] = min(smallest.get(c, i), i)
    assert all(got[i]["component_id"] == smallest[c] for (i, _), c in zip(rows, want))


def test_null_ids_and_empty(spark):
    got = rows_of(simhash.near_duplicates(table(spark, [(None, "a b c d"), (5, "a b c d"), (None, "quite another text here now")])))
    assert sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in got) == [("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_crowded_keys_go_deeper(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(120)})
    fps = np.array(fps, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for direct in (12, 256):
        edges = simhash.links(df, direct=direct)
        pairs = np.array([tuple(r) for r in edges.collect()], np.int64).view(np.uint64).reshape(-1, 2)
        assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 64).all()
        roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
        label = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
        want = classes(fps)
        assert len(set(zip(label, want))) == len(set(want)) == len(set(label))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_keep_one(spark):
    docs = table(spark, [(3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "other words entirely in here"), (None, "null id alone of this kind")])
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in rows_of(left)) == ["2", "9", "None"]


def test_unconverged_components_are_an_error(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1).collect()
