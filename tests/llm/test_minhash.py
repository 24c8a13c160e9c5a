import random

import pytest

from tidelog.llm import minhash, simhash

from .helpers import rows_of, table


def jaccard(a, b):
    a, b = (set(zip(*[t.lower().split()[k:] for k in range(5)])) for t in (a, b))
    return len(a & b) / len(a | b)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept(docs, **args):
    return sorted((r["doc_id"], r["text"]) for r in rows_of(simhash.keep_one(docs, **args)))


def test_planted_near_copies_go(spark):
    """A copy with some words replaced goes from a similarity of 0.8 on, and stays below it."""
    rng, rows, want = random.Random(3), [], []
    for k in range(150):
        w = words(rng, 120 + rng.randrange(200))
        c = list(w)
        for at in rng.sample(range(0, len(w), 5), rng.choice([1, 2, 3, 4, 5])):
            c[at] = f"x{k}"
        a, b = " ".join(w), " ".join(c)
        rows += [(2 * k, a), (2 * k + 1, b)]
        want += [(2 * k, a)] + ([(2 * k + 1, b)] if jaccard(a, b) < 0.8 else [])
    assert 150 < len(want) < 300
    assert kept(table(spark, rows)) == sorted(want)


@pytest.mark.parametrize("direct", [4, 32])
def test_crowded_bands(spark, direct):
    """Many texts with a long passage in common are not near copies; among them some pairs are, and a large group is."""
    rng = random.Random(8)
    passage, base = words(rng, 60), words(rng, 200)
    rows = [(i, " ".join(passage + words(rng, 22))) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 120, 10)]
    rows += [(2000 + i, " ".join(base[:-1] + [f"y{i}"])) for i in range(80)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.8 <= jaccard(rows[0][1], rows[120][1])
    assert [i for i, _ in kept(table(spark, rows), direct=direct)] == [*range(120), 2000]


def test_signature_of_odd_texts():
    a, b = minhash.permutations()
    assert len(minhash.shingles(None)) == len(minhash.shingles(" \n")) == 0
    assert len(minhash.shingles("One two")) == 1 and (minhash.shingles("One two") == minhash.shingles("one  two")).all()
    assert (minhash.bands(minhash.shingles("x " * 20_000), a, b) == minhash.bands(minhash.shingles("x x x x x"), a, b)).all()


def test_ids_do_not_decide_how_many_rows_stay(spark):
    rows = [(None, "one text without an id"), (None, "quite another text without an id"), (None, None), (4, "some words under the number four"), (4, "unrelated things under the same number")]
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["text"])) for r in rows_of(simhash.keep_one(table(spark, rows + rows))))
