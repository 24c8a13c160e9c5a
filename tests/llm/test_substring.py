import hashlib
import random

import pytest

from tidelog.llm import substring

from .helpers import rows_of, table


def brute(rows, window):
    """(doc_id, n_words, n_removed, sha) of each row by a dictionary of all windows."""
    import re

    split = [(10**18 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for a in range(len(words) - window + 1):
            w = tuple(words[a : a + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, words), (raw, _) in zip(split, rows):
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            if first[tuple(words[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((raw, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [words(rng, rng.choice([10, 49, 50, 51, 120, 400])) for _ in range(60)]
    passage = words(rng, 77)
    out = []
    for i, w in enumerate(base):
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + passage[rng.randrange(10) :] + w[at:]
        if i % 7 == 0:
            w = base[i - 3][:90] + w
        out.append((rng.randrange(40), "\n ".join(w)))
    long = words(rng, 30_000)
    out += [(500, " ".join(long)), (501, "x " + " ".join(long[1000:29_000])), (3, ""), (4, None), (None, " ".join(passage)), (None, " ".join(passage)), (7, "é " * 200), (8, " é " * 200)]
    out += [out[0], out[0], (600, out[0][1])]
    return out


@pytest.mark.parametrize("flush", [600_000, 700])
def test_matches_brute_force(spark, rows, flush, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", flush)
    got = rows_of(substring.deduplicate(table(spark, rows).repartition(5)))
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=repr) == brute(rows, 50)


def test_hot_hashes_are_dealt_by_digest(spark, monkeypatch):
    """A passage of 40 words between words of its own in every document, and a longer one with and without ids."""
    rng = random.Random(5)
    short, long = words(rng, 40), words(rng, 70)
    rows = [(i, " ".join(words(rng, 30) + (short if i % 2 else long) + words(rng, 30))) for i in range(120)]
    rows += [(None, " ".join(words(rng, 20) + long + words(rng, 9))) for _ in range(40)]
    monkeypatch.setattr(substring, "SAMPLED", 1)
    monkeypatch.setattr(substring, "RARE", 8)
    seen, before = [], substring.hot_hashes
    monkeypatch.setattr(substring, "hot_hashes", lambda *a: seen.append(before(*a)) or seen[-1])
    got = rows_of(substring.deduplicate(table(spark, rows).repartition(5)))
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=repr) == brute(rows, 50)
    assert 0 < len(seen[0]) <= 4 * 2 * 4
    ranges = [tuple(r) for r in substring.maximal_repeats(table(spark, rows)).collect()]
    assert len(ranges) == 59 + 40 and all(b - a >= 70 for _, a, b in ranges) and (2, 30, 100) in ranges


def test_strip_keeps_columns_and_clean_texts(spark, rows):
    docs = table(spark, [(1, "a  b\nc"), (2, " ".join(map(str, range(60)))), (3, " ".join(map(str, range(60)))), (4, None), (5, "")])
    left = substring.strip(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in rows_of(left)} == {1: "a  b\nc", 2: " ".join(map(str, range(60))), 4: None, 5: ""}


def test_empty_table(spark):
    assert substring.deduplicate(table(spark, [])).count() == 0


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted([tuple(r) for r in substring.deduplicate(docs).collect()], key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
