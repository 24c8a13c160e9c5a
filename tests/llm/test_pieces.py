import array
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidelog.llm import pieces

from .helpers import rows_of, table

P = pytest.importorskip("public_tokenizers")
SP = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
V = pieces.Vocabulary(PATH)
LIBRARY = SP.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same file with the model type changed to unigram."""
    out = bytearray()
    for n, value in pieces.message(open(PATH, "rb").read()):
        if n == 2:
            at = value.index(b"\x18\x02")
            value = value[:at] + b"\x18\x01" + value[at + 2 :]
        size, head = len(value), bytearray([n << 3 | 2])
        while size > 127:
            head.append(size & 127 | 128)
            size >>= 7
        out += head + bytes([size]) + value
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(bytes(out))
    return str(path)


ODD = [(1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "é𝒳\n\tz\x00"), (6, "▁ x"), (None, "ab"), (None, "ab"), (7, "x" * 3000), (8, "lorem ipsum dolor " * 400), (9, "𝒳" * 700 + "abcde" * 300), (10, " " * 900)]


def check(got, rows):
    def expected(ident, text):
        ids = LIBRARY.encode(text)
        return ident, len(text), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()

    want = sorted([expected(i, t or "") for i, t in rows], key=repr)
    assert sorted([tuple(r[c] for c in ("doc_id", "n_chars", "n_tokens", "ids_crc32", "decoded_sha256")) for r in got], key=repr) == want


def test_odd_texts_whole_and_in_chunks(spark):
    for chunk in (1 << 16, 33):
        check(rows_of(pieces.round_trip(table(spark, ODD), PATH, chunk=chunk)), ODD)
    assert pieces.round_trip(table(spark, []), PATH).count() == 0
    with pytest.raises(Exception, match="longer"):
        pieces.round_trip(table(spark, ODD), PATH, chunk=20).collect()


def test_documents_have_the_librarys_ids(spark, sf_dir):
    """Real documents, those of 200 characters or more by the scan, with several blocks of chunks in the longest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(rows_of(pieces.round_trip(docs, PATH, chunk=200)), [(r["doc_id"], r["text"]) for r in docs.collect()])


def scanned(v, text, size):
    marked, chunks = pieces.mark(text), []
    for at in range(0, len(marked), size):
        lead = min(at, 2 * v.longest)
        chunks.append(pieces.Chunk(v, marked[at - lead : at + size + v.longest], lead, min(size, len(marked) - at)))
    found = [c.matrix() for c in chunks]
    cuts = pieces.cuts_between(found, 0, int(np.argmax(pieces.tree(found)[0])))
    return array.array("I", b"".join(c.encode(s, t) for c, s, t in zip(chunks, cuts, cuts[1:]))).tolist(), found


def junk(rng):
    n = rng.randrange(40, 300)
    return rng.choice(
        [
            lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)),
            lambda: "".join(rng.choices("aeinorst", k=n)),
            lambda: "".join(rng.choices("ab ▁\n中文é😀", k=n)),
            lambda: " " * rng.randrange(60) + "the" * rng.randrange(60) + "  " * rng.randrange(30) + "x" * n,
            lambda: "".join(chr(rng.randrange(32, 0x3000)) for _ in range(n)),
            lambda: "".join(rng.choices(["tion", "the", "er", "ing", " ", "ation", "s"], k=n)),
        ]
    )()


def test_the_scan_has_the_librarys_ids():
    rng = random.Random(6)
    for _ in range(200):
        text = junk(rng)
        for size in (2 * V.longest, 50):
            assert scanned(V, text, size)[0] == LIBRARY.encode(text), repr(text)


def test_the_scan_reaches_the_librarys_score_in_unigram_models(unigram):
    """The library adds up in single precision, so that it can miss the best way where a piece of score -1e9 is in it."""
    v, rng = pieces.Vocabulary(unigram), random.Random(7)
    assert v.kind == pieces.UNIGRAM
    scores = {v.id[p]: s for p, s in v.score.items()}
    for _ in range(60):
        text = "".join(rng.choices("aeinorst", k=rng.randrange(40, 200))) + rng.choice(["", " of words", "  "])
        ours, theirs = scanned(v, text, 40)[0], v.library.encode(text)
        assert v.library.decode(ours) == text == v.library.decode(theirs)
        lost = sum(scores[i] for i in ours) - sum(scores[i] for i in theirs)
        assert lost == 0 or 0 < lost < 100 * len(text) and any(scores[i] < -1e8 for i in ours)
        nodes = pieces.ways(v, pieces.mark(text), 0, None, len(text) + 1)[len(text) + 1]
        assert max(w for w, _ in nodes.values()) == sum(scores[i] for i in ours)


def test_combining_is_associative():
    ms = scanned(V, "unbrokentextofmanyletters" * 9, 40)[1]
    rng = np.random.default_rng(1)
    ms = [np.where(np.isfinite(m), rng.integers(-9, 9, m.shape), m) for m in ms]
    left = ms[0]
    for m in ms[1:]:
        left = pieces.combine(left, m)
    assert (left == pieces.tree(ms)).all() and np.isfinite(left).any()
    best = pieces.cuts_between(ms, 0, int(np.argmax(left[0])))
    assert sum(m[s, t] for m, s, t in zip(ms, best, best[1:])) == left[0].max()


def test_encode_then_decode(spark):
    encoded = pieces.encode(table(spark, ODD), PATH, chunk=100)
    got = sorted((repr(r["doc_id"]), r["text"]) for r in rows_of(pieces.decode(encoded, PATH)))
    assert got == sorted((repr(i), (t or "").replace("▁", " ")) for i, t in ODD)
