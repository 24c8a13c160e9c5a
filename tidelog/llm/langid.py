"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits.  One binary classifier per bit
(logistic regression over hashed byte n-grams) predicts that bit for a text, and
a loss-weighted decoder picks the nearest codeword.  The classifiers are linear,
so scoring a text is a sum of weight rows over its n-grams: whole texts of any
length are scored in pieces of bounded memory.

Defined cases: a null text or one without a letter gives ``und`` with score 0;
a null doc_id counts as a training row when its language is known; rows with a
null language are never learned from; an empty table or one without labelled rows
gives ``und`` everywhere; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RESULT = "lang_pred string, score double, ambiguous boolean"
STEP = 1 << 16


def letters_table() -> np.ndarray:
    """Bytes to bytes: ASCII other than letters becomes a space, all else stays."""
    table = np.arange(256, dtype=np.uint8)
    for i in range(128):
        if not chr(i).isalpha():
            table[i] = 32
    return table


def ngrams(text: str, bits: int) -> np.ndarray:
    """Hashed byte 2-, 3- and 4-grams of the lower-cased text, repeats included."""
    raw = letters_table()[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    c = raw[keep].astype(np.uint32)
    grams, value = [], c
    for n in (2, 3, 4):
        if len(c) < n:
            break
        value = (value[:-1] << np.uint32(8)) | c[n - 1 :]
        h = value * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        grams.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits))
    return np.concatenate(grams) if grams else np.zeros(0, np.uint32)


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords as rows: all splits for up to 5 languages, else the best random code found."""
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        splits = [[(k >> i) & 1 for i in range(n - 1)] + [0] for k in range(1, 2 ** (n - 1))]
        return (np.array(splits, np.float32).T * 2 - 1).astype(np.float32)
    rng, width, best, found = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), -1, None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, width)).astype(np.float32)
        if (np.abs(m.sum(0)) == n).any():
            continue
        gap = ((width - m @ m.T) / 2 + width * np.eye(n)).min()
        if gap > best:
            best, found = gap, m
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # n-gram x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in the decoding loss
    bits: int
    ambiguity: float

    def margins(self, text: str) -> np.ndarray:
        grams = ngrams(text, self.bits)
        total = np.zeros(len(self.bias))
        for at in range(0, len(grams), STEP):
            total += self.weights[grams[at : at + STEP]].sum(0, dtype=np.float64)
        return total / max(1, len(grams)) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.ambiguity)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        return self.decode(self.margins(text))


def samples(text: str) -> list[str]:
    """A training text and two short cuts from it, so that short texts are learned too."""
    at = len(text) // 3
    return [text, text[at : at + 60], text[at // 2 : at // 2 + 200]]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, float]], bits: int, ambiguity: float, epochs: int = 40) -> Model:
    """rows: language, distinct n-grams, their shares of the text, and a number in [0, 1) that deals a fifth out for trust."""
    languages = sorted({r[0] for r in rows})
    code = code_matrix(len(languages))
    width, size = code.shape[1], 1 << bits
    scale = np.float32(np.sqrt(size))
    weights, bias = np.zeros((size, width), np.float32), np.zeros(width, np.float32)
    grad2, bias2 = np.full((size, width), 1e-4, np.float32), np.full(width, 1e-4, np.float32)
    target = np.array([code[languages.index(r[0])] for r in rows], np.float32).reshape(len(rows), width)
    learn = np.array([i for i, r in enumerate(rows) if r[3] >= 0.2], int)
    check = np.array([i for i, r in enumerate(rows) if r[3] < 0.2], int)
    per_class = np.array([1.0 / max(1, sum(rows[i][0] == lang for i in learn)) for lang in languages], np.float32)
    row_weight = np.array([per_class[languages.index(r[0])] for r in rows], np.float32)

    def dense(ids):
        x = np.zeros((len(ids), size), np.float32)
        for k, i in enumerate(ids):
            x[k, rows[i][1]] = rows[i][2] * scale
        return x

    rng = np.random.default_rng(11)
    for _ in range(epochs if width else 0):
        rng.shuffle(learn)
        for at in range(0, len(learn), 128):
            ids = learn[at : at + 128]
            x, y = dense(ids), target[ids]
            w = row_weight[ids][:, None] / row_weight[ids].sum()
            g = -y * w / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
            gw, gb = x.T @ g + 1e-6 * weights, g.sum(0)
            grad2 += gw * gw
            bias2 += gb * gb
            weights -= 0.5 * gw / np.sqrt(grad2)
            bias -= 0.1 * gb / np.sqrt(bias2)
    trust = np.ones(width)
    if width and len(check):
        right = np.concatenate([(dense(check[at : at + 128]) @ weights + bias) * target[check[at : at + 128]] > 0 for at in range(0, len(check), 128)])
        trust = np.maximum(0.05, 2 * right.mean(0) - 1)
    return Model(languages, code, weights * scale, bias, trust / max(trust.mean(), 1e-9) if width else trust, bits, ambiguity)


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 300,
    bits: int = 13,
    ambiguity: float = 0.5,
) -> Model:
    """Fit on at most ``per_language`` documents of each language (the documented bound).

    Of the documents whose crc32(doc_id as text) mod 3 is not 1, those with the
    smallest hashes of (id, language) are taken.  The hash threshold comes from counts of all
    rows, so only about three times the sample is shuffled, however large the table.
    The driver gets sparse n-gram shares of fixed dimension, never texts.
    """
    ident, label = common.long_column(docs, doc_id), F.col(f"`{lang}`").cast("string")
    body = common.text_column(docs, text)
    rows = docs.where(label.isNotNull() & (common.crc_mod(ident, 3) != 1))
    counts = {r[0]: r[1] for r in rows.groupBy(label.alias("l")).count().collect()}
    if not counts:
        return Model([], np.ones((0, 0)), np.zeros((1 << bits, 0)), np.zeros(0), np.zeros(0), bits, ambiguity)
    part = F.pmod(F.xxhash64(ident, label), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 3.0 * per_language / n))])
    w = Window.partitionBy("l").orderBy("part", "doc_id")
    chosen = (
        rows.select(ident.alias("doc_id"), label.alias("l"), body.alias("text"), part.alias("part"))
        .where((F.col("part") <= shares[F.col("l")]) & F.col("text").isNotNull())
        .withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= per_language)
        .select("l", "text", "part", "pos")
    )
    schema = pa.schema([("l", pa.string()), ("grams", pa.binary()), ("shares", pa.binary()), ("deal", pa.float64())])

    def featurize(stream):
        for batch in stream:
            out = {f.name: [] for f in schema}
            for label_, text_, pos in zip(batch["l"].to_pylist(), batch["text"], batch["pos"].to_pylist(), strict=True):
                for cut in samples(text_.as_py()):
                    grams, n = np.unique(ngrams(cut, bits), return_counts=True)
                    if len(grams) and any(map(str.isalpha, cut)):
                        out["l"].append(label_)
                        out["grams"].append(grams.astype("<u4").tobytes())
                        out["shares"].append((n / n.sum()).astype("<f4").tobytes())
                        out["deal"].append(pos % 5 / 5)
            yield common.batches(out, schema)

    got = chosen.mapInArrow(common.lean(featurize), "l string, grams binary, shares binary, deal double").collect()
    data = [(r[0], np.frombuffer(r[1], "<u4"), np.frombuffer(r[2], "<f4"), r[3]) for r in sorted(got)]
    return fit(data, bits, ambiguity)


def predictions(docs: DataFrame, model: Model, text: str = "text"):
    """A struct column (lang_pred, score, ambiguous) over every whole text."""
    shared = common.Shared(docs.sparkSession, model)  # 2**bits x code bits, whatever the corpus

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.load()
        rows = [m.predict(t.as_py()) for t in texts]
        names, scores, unsure = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
            ["lang_pred", "score", "ambiguous"],
        )

    return predict(common.text_column(docs, text))


def identify(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit_args) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per input row."""
    model = model or train(docs, doc_id, text, lang, **fit_args)
    ident = common.long_column(docs, doc_id)
    return docs.select(
        ident.alias("doc_id"), (common.crc_mod(ident, 3) == 1).alias("held_out"), predictions(docs, model, text).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def accept(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, columns unchanged, whose text is in some language: ``und`` goes, and so does a text that no codeword fits."""
    model = model or train(docs, doc_id, text, lang)
    (p,) = common.unused(docs, "prediction")
    return docs.withColumn(p, predictions(docs, model, text)).where((F.col(p)["lang_pred"] != "und") & ~F.col(p)["ambiguous"]).drop(p)
