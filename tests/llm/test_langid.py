import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import langid

from .helpers import rows_of, table


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    odd = [(None, "the and of", "en"), (901, None, "en"), (902, "", None), (903, "12 %% 4 ", "fr"), (904, "the " * 30_000, None), (904, "the " * 30_000, None)]
    got = rows_of(langid.identify(table(spark, rows + odd)))
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (901, 902, 903))
    assert by[904]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    kept = langid.accept(table(spark, rows + odd))
    assert "prediction" in kept.columns and kept.count() >= len(rows)


def test_without_labels(spark):
    got = rows_of(langid.identify(table(spark, [(1, "abc", None)])))
    assert got[0]["lang_pred"] == "und"
    assert langid.identify(table(spark, [])).count() == 0


def test_one_language(spark):
    got = rows_of(langid.identify(table(spark, [(i, "abc def", "xx") for i in range(9)])))
    assert {r["lang_pred"] for r in got} == {"xx"}


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 40):
        m = langid.code_matrix(n)
        gap = (m.shape[1] - m @ m.T) / 2
        assert min(gap[i, j] for i in range(n) for j in range(n) if i != j) >= (1 if n < 4 else 3)
        assert (np.abs(m.sum(0)) < n).all()


def plain_grams(text, bits):
    """n-grams one by one: lower case, other ASCII than letters as single spaces, 2 to 4 bytes."""
    raw, line = (" " + text.lower() + " ").encode(), bytearray()
    for b in raw:
        b = b if b >= 128 or chr(b).isalpha() else 32
        if not (b == 32 and line and line[-1] == 32):
            line.append(b)
    out = []
    for n in (2, 3, 4):
        for at in range(len(line) - n + 1):
            h = int.from_bytes(line[at : at + n], "big") * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - bits))
    return out


def test_decoding_and_the_flag_against_a_plain_version(spark):
    """Margins summed gram by gram, losses codeword by codeword, the least one wins and a share below the bound is ambiguous."""
    import math

    rng, bits = np.random.default_rng(4), 8
    names = ["aa", "bb", "cc", "dd", "ee", "ff"]
    code = langid.code_matrix(len(names))
    width = code.shape[1]
    model = langid.Model(names, code, rng.normal(0, 3, (1 << bits, width)), rng.normal(0, 0.2, width), rng.uniform(0.2, 1, width), bits, 0.6)
    texts = ["one two three", "Été, 12 où?", "a", "żółć  --  x", "zz " * 500, "the the the", "Ünï", None, "", "12 34"]
    rows, flags = list(enumerate(texts)), []
    for r in rows_of(langid.identify(table(spark, rows), model)):
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0, True)
            continue
        grams = plain_grams(text, bits)
        margins = [sum(model.weights[g][b] for g in grams) / len(grams) + model.bias[b] for b in range(width)]
        losses = [sum(model.trust[b] * math.log1p(math.exp(-code[k][b] * margins[b])) for b in range(width)) for k in range(len(names))]
        shares = [math.exp(min(losses) - x) for x in losses]
        best = shares.index(max(shares))
        assert r["lang_pred"] == names[best] and abs(r["score"] - shares[best] / sum(shares)) < 1e-6
        assert r["ambiguous"] == (shares[best] / sum(shares) < 0.6)
        flags.append(r["ambiguous"])
    assert True in flags and False in flags
