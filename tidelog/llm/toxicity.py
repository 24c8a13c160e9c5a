"""Toxicity by class-conditional Kneser-Ney language models.

Labelled texts give two models of how words go on, letter by letter, one of toxic and one of
ordinary text: P(next letter | word so far), with the word's end as a letter.  A count is
the number of different documents a word is in, so that a repeated passage counts once.  The models are interpolated:

* P_class(x | h) has the class's counts of h x, each less a discount (one standard error, at least ``DISCOUNT``);
  what the discounts free is spread by
* P(x | h), which both classes share: counts of either class less the Kneser-Ney discount n1 / (n1 + 2 n2), and
* below it the continuation distributions of the last 2, 1 and 0 letters, also shared: there a
  letter counts by the number of different words so far, then of different letters, that it follows.

So a rare beginning or ending counts alike for both, a letter that a class has never seen after h costs each class
what its own discounts have freed, and words that vary a known stem still show their class.  Words are read to their end,
whatever their length (beyond ``LETTERS`` letters in pieces), and no count is left out.

A text's score compares the log-likelihoods of its words.  A word counts as far as its
log-likelihood ratio exceeds ``margin``, which leaves out what a class merely happens to say
more often; the sum, per word and per square root of the words, goes through a logistic function.

Counts cover all labelled rows and are made by grouped aggregation.  What a word's ratio comes to depends on its longest
beginning that the model has.  Of the model only those beginnings that take a word beyond the margin are needed, and
the ones that follow them: every other word has a ratio within the margin, which counts as 0.  That exact selection is broadcast up to
``BROADCAST`` entries; a larger one stays a table, and the distinct words of the texts are joined to it by shuffles.
The logistic weights are fitted on about ``calibrate`` labelled documents that gave no counts (the documented bound).

Rows with crc32(doc_id as text) mod 5 = 0 are held out; 1 calibrates, 2 to 4 count.

Defined cases: a null text is empty; a text without words has a difference of 0;
a label of null is none, of several labels of a document the largest counts; a null doc_id is scored
but has no label; without labels of both classes all scores are 0; repeated rows get equal
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

DISCOUNT = 0.75
END = " "
#: A longer run of letters is read in pieces of so many.
LETTERS = 64
#: Letters of the longest shared context below the word so far.
SHORT = 2
FLUSH = 1_000_000
CACHED_WORDS = 300_000
#: Labels up to this number of rows are broadcast; more are joined by a shuffle.
FEW_LABELS = 1_000_000
#: Entries of a model that is broadcast, 16 bytes each.
BROADCAST = 1_000_000


def word_table() -> bytes:
    """Lower case; ASCII other than letters and digits becomes a space."""
    return bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))


def words_of(text: str | None, table: bytes) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(table).split()
    if words and len(max(words, key=len)) > LETTERS:
        words = [piece for w in words for piece in pieces(w)]
    return words


def pieces(word: bytes) -> list[bytes]:
    if len(word) <= LETTERS:
        return [word]
    letters = word.decode("utf-8", "replace")
    return [letters[at : at + LETTERS].encode() for at in range(0, len(letters), LETTERS)]


def beyond(value: float, margin: float) -> float:
    return max(value - margin, 0.0) + min(value + margin, 0.0)


@dataclass
class Model:
    entries: dict[int, float] | None  # hash of a beginning -> how far a word that has it as the longest one exceeds the margin
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    table: DataFrame | None = None  # key, value, where the entries are too many

    def score(self, a: float, b: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.array([1.0, a, b]), -30, 30))))


class Differences(dict):
    """Words to their differences of log-likelihoods beyond the margin; words are remembered while there is room."""

    def __init__(self, model: Model):
        self.model, self.table = model, word_table()

    def __missing__(self, word: bytes) -> float:
        letters, find, value = word.decode("utf-8", "replace") + END, self.model.entries.get, None
        n = len(letters)
        while value is None and n >= 0:
            digest = xxhash.xxh64_intdigest(letters[:n].encode(), 42)
            value = find(digest - (1 << 64) if digest >> 63 else digest)
            n -= 1
        value = value or 0.0
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value

    def features(self, text: str | None) -> tuple[float, float]:
        words = words_of(text, self.table)
        total, n = sum(map(self.__getitem__, words)), max(1, len(words))
        return total / n, total / n**0.5

    def score(self, text: str | None) -> float:
        return self.model.score(*self.features(text))


def starts_of(word, least: int):
    """All beginnings of a word with its end, of ``least`` letters or more."""
    full = F.concat(word, F.lit(END))
    return F.transform(F.sequence(F.lit(least), F.length(full)), lambda n: F.substring(full, F.lit(1), n))


def features(rows: DataFrame, model: Model) -> DataFrame:
    """row, a, b of the rows (row, text), by joins of their distinct words with the model's table."""

    def split(stream):
        table = word_table()
        for batch in stream:
            for row, body in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                counts = collections.Counter(words_of(body.as_py(), table))
                n = max(1, counts.total())
                words = pa.array([w.decode("utf-8", "replace") for w in counts] or [""], pa.string())  # a text without words keeps its row
                times = pa.array(list(counts.values()) or [0], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array([n] * len(words), pa.int64()), words, times], names=["row", "n", "word", "times"])

    used = common.materialize(rows.select("row", "text").mapInArrow(common.lean(split), "row long, n long, word string, times long"), "toxicity-words")
    each = used.where("times > 0").select("word").distinct().select("word", F.explode(starts_of(F.col("word"), 0)).alias("start"))
    met = each.select("word", F.length("start").alias("at"), F.xxhash64("start").alias("key")).join(model.table, "key")
    weight = met.groupBy("word").agg(F.max_by("value", "at").alias("d")).where("d <> 0")
    sums = used.join(weight, "word", "left").groupBy("row").agg(F.first("n").alias("n"), F.coalesce(F.sum(F.col("d") * F.col("times")), F.lit(0.0)).alias("s"))
    return sums.select("row", (F.col("s") / F.col("n")).alias("a"), (F.col("s") / F.sqrt("n")).alias("b"))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """text, toxic, fold of the labelled rows that are not held out."""
    ident = common.long_column(labels, doc_id)
    marks = labels.select(ident.alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marks = common.materialize(marks.where(common.crc_mod(F.col("id"), 5) != 0).groupBy("id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    rows = docs.select(common.long_column(docs, doc_id).alias("id"), common.text_column(docs, text).alias("text"))
    side = F.broadcast(marks) if marks.count() <= FEW_LABELS else marks
    return rows.join(side, "id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), common.crc_mod(F.col("id"), 5).alias("fold"))


def counted(rows: DataFrame) -> DataFrame:
    """word, toxic, ordinary: the numbers of documents of each class with the word, summed in the task before they are shuffled."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())])

    def run(stream):
        table = word_table()
        counts: tuple[collections.Counter, collections.Counter] = (collections.Counter(), collections.Counter())

        def flush():
            words = list(counts[0].keys() | counts[1].keys())
            out = [pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), *[pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0)]]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        for batch in stream:
            for body, mark in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                counts[mark].update(set(words_of(body.as_py(), table)))
                if len(counts[0]) + len(counts[1]) >= FLUSH // 4:
                    yield flush()
        yield flush()

    part = rows.select("text", "toxic").mapInArrow(common.lean(run), "word string, toxic long, ordinary long")
    return part.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def beginnings(words: DataFrame) -> DataFrame:
    """start, toxic, ordinary: word counts summed for every beginning, the empty one too."""
    each = words.select(F.explode(starts_of(F.col("word"), 0)).alias("start"), "toxic", "ordinary")
    return each.groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_discount(counts: DataFrame, column: str = "n") -> float:
    """n1 / (n1 + 2 n2), 0.5 where no count is 1."""
    row = counts.agg(F.count_if(F.col(column) == 1).alias("n1"), F.count_if(F.col(column) == 2).alias("n2")).first()
    return row["n1"] / (row["n1"] + 2 * row["n2"]) if row["n1"] else 0.5


def continuations(children: DataFrame) -> DataFrame:
    """s, x, p: how likely letter ``x`` is after the last letters ``s`` of different words so far; children: before, letter."""
    levels, suffix = [], children.select(F.right("before", F.lit(SHORT)).alias("s"), F.col("letter").alias("x"))
    for k in range(SHORT, -1, -1):
        levels.append(common.materialize(suffix.groupBy("s", "x").agg(F.count("*").alias("n")), f"toxicity-continuations-{k}"))
        suffix = levels[-1].select(F.right("s", F.lit(k - 1)).alias("s"), "x") if k else None
    below = None
    for level in reversed(levels):  # from no letters to the longest
        d, context = shared_discount(level), Window.partitionBy("s")
        sized = level.withColumns({"total": F.sum("n").over(context), "kinds": F.count("*").over(context)})
        if below is None:
            lower = sized.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            # the last letters without the first of them; a whole short word so far stays as it is
            sized = sized.withColumn("under", F.when(F.length("s") > below[1], F.right("s", F.lit(below[1]))).otherwise(F.col("s")))
            lower = sized.join(below[0].select(F.col("s").alias("under"), "x", F.col("p").alias("lower")), ["under", "x"])
        p = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("lower")) / F.col("total")
        below = (lower.select("s", "x", p.alias("p")), 0 if below is None else below[1] + 1)
    return below[0]


def discounted(count):
    return F.greatest(count - F.greatest(F.lit(DISCOUNT), F.sqrt(count)), F.lit(0.0))


def steps(starts: DataFrame) -> DataFrame:
    """start, step, leave: the difference of the two models' log-probabilities of its last letter, and of any letter not seen in its place."""
    children = starts.where("start <> ''").select("start", "toxic", "ordinary", (F.col("toxic") + F.col("ordinary")).alias("n"), F.substring("start", F.lit(1), F.length("start") - 1).alias("before"), F.right("start", F.lit(1)).alias("letter"))
    d = shared_discount(children)
    likely = continuations(children)
    rows = children.withColumns({"s": F.right("before", F.lit(SHORT)), "x": F.col("letter"), "dt": discounted(F.col("toxic")), "do": discounted(F.col("ordinary"))})
    rows = rows.join(likely, ["s", "x"]).drop("s", "x", "letter")
    contexts = children.select("before", "toxic", "ordinary", "n", discounted(F.col("toxic")).alias("dt"), discounted(F.col("ordinary")).alias("do"))
    contexts = contexts.groupBy("before").agg(F.sum("toxic").alias("nt"), F.sum("ordinary").alias("no"), F.sum("dt").alias("st"), F.sum("do").alias("so"), F.count("*").alias("kinds"))
    freed = {c: F.when(F.col(n) == 0, 1.0).otherwise(1 - F.col(k) / F.col(n)) for c, n, k in (("ft", "nt", "st"), ("fo", "no", "so"))}
    rows = rows.join(contexts.withColumns(freed), "before")
    shared = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("p")) / (F.col("nt") + F.col("no"))

    def probability(kept: str, count: str, free: str):
        return F.when(F.col(count) == 0, 0.0).otherwise(F.col(kept) / F.col(count)) + F.col(free) * F.col("shared")

    rows = rows.withColumn("shared", shared)
    tiny = F.lit(1e-9)
    return rows.select("start", F.log(probability("dt", "nt", "ft") / probability("do", "no", "fo")).alias("step"), F.log(F.greatest(F.col("ft"), tiny) / F.greatest(F.col("fo"), tiny)).alias("leave"))


def selected(rows: DataFrame, margin: float) -> DataFrame:
    """key, value: the beginnings (start, step, leave) that take a word beyond the margin and those that follow one of them.

    Rows are sorted in ranges; a beginning stands before all that go on from it, so that the sum of the steps
    to each needs a stack as long as a word.  What a range's first rows need from before is
    looked up for the ranges' first beginnings alone.
    """
    spark = rows.sparkSession
    parts = 2 * common.partitions(spark)
    ranged = common.materialize(rows.repartitionByRange(parts, "start").withColumn("part", F.spark_partition_id()), "toxicity-steps")
    heads = ranged.groupBy("part").agg(F.min("start").alias("head"))  # one row a range
    needed = heads.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda n: F.substring("head", F.lit(1), n))).alias("start")).distinct()
    known = common.Shared(spark, {r["start"]: r["step"] for r in ranged.join(F.broadcast(needed), "start").select("start", "step").collect()})
    schema = pa.schema([("start", pa.string()), ("value", pa.float64())])

    def walk(stream):
        before, part, path, sums = known.load(), None, "", [0.0]
        for batch in stream:
            out = {f.name: [] for f in schema}
            for own, start, step, leave in zip(*[batch[c].to_pylist() for c in ("part", "start", "step", "leave")], strict=True):
                parent = start[:-1]
                if own != part or len(sums) < len(start):
                    sums = [0.0]
                    for n in range(1, len(parent) + 1):
                        sums.append(sums[-1] + before[start[:n]])
                    part = own
                else:
                    del sums[len(start) :]
                sums.append(sums[-1] + step)
                left = beyond(sums[-2] + leave, margin)
                if left:
                    out["start"] += [parent, start]
                    out["value"] += [left, 0.0]
                if start[-1] == END:
                    whole = beyond(sums[-1], margin)
                    if whole:
                        out["start"].append(start)
                        out["value"].append(whole)
            yield common.batches(out, schema)

    found = ranged.repartition(parts, "part").sortWithinPartitions("part", "start").select("part", "start", "step", "leave").mapInArrow(common.lean(walk), "start string, value double")
    return found.groupBy(F.xxhash64("start").alias("key")).agg(F.max_by("value", F.abs("value")).alias("value"))


def columns(df: DataFrame) -> list[np.ndarray]:
    """A bounded result as arrays."""
    table = df.toArrow()
    return [table[c].to_numpy() for c in df.columns]


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    margin: float = 2.0,
    calibrate: int = 20_000,
    broadcast: int = BROADCAST,
) -> Model | None:
    rows = labelled(docs, labels, doc_id, text, label)
    starts = common.materialize(beginnings(counted(rows.where("fold > 1"))), "toxicity-beginnings")
    total = starts.where("start = ''").first()
    if total is None or not total["toxic"] or not total["ordinary"]:
        return None
    kept = common.materialize(selected(steps(starts), margin), "toxicity-model")
    if kept.count() > broadcast:
        model = Model(None, table=kept)
    else:
        key, value = columns(kept)
        model = Model(dict(zip(key.tolist(), value.tolist(), strict=True)))

    held = rows.where("fold = 1").select("text", "toxic")
    n = held.count()
    part = F.pmod(F.xxhash64("text", F.lit("calibrate")), F.lit(1 << 30)) / float(1 << 30)
    held = held.where(part < min(1.0, calibrate / max(n, 1))) if n > calibrate else held
    if model.table is not None:
        sample = common.materialize(held.select("toxic", "text", F.monotonically_increasing_id().alias("row")), "toxicity-calibrate")
        y, a, b = columns(sample.join(features(sample, model), "row").select("toxic", "a", "b"))
        model.weights = logistic(np.stack([np.ones(len(y)), a, b], axis=1), y.astype(np.float64))
        return model
    box = common.Shared(docs.sparkSession, model)

    def measure(stream):
        differences = Differences(box.load())
        for batch in stream:
            found = [differences.features(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["toxic"], *[pa.array([f[k] for f in found], pa.float64()) for k in range(2)]], names=["toxic", "a", "b"])

    y, a, b = columns(held.mapInArrow(common.lean(measure), "toxic int, a double, b double"))
    model.weights = logistic(np.stack([np.ones(len(y)), a, b], axis=1), y.astype(np.float64))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; features are scaled first."""
    scale = np.maximum(np.abs(x).mean(0), 1e-9) if len(x) else np.ones(x.shape[1])
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
    return w / scale


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **fit_args) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    model = model or train(docs, labels, doc_id, text, label, **fit_args)
    if model is not None and model.table is not None:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))
        rows = common.materialize(rows, "toxicity-rows")
        w = [float(x) for x in model.weights]
        z = F.greatest(F.least(w[0] + w[1] * F.col("a") + w[2] * F.col("b"), F.lit(30.0)), F.lit(-30.0))
        return decided(rows.select("row", "doc_id").join(features(rows, model), "row").select("doc_id", (1 / (1 + F.exp(-z))).alias("score")))
    box = common.Shared(docs.sparkSession, model)

    def run(stream):
        found = box.load()
        differences = Differences(found) if found else None
        for batch in stream:
            scores = [differences.score(t.as_py()) if differences is not None else 0.0 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))
    return decided(rows.mapInArrow(common.lean(run), "doc_id long, score double"))


def decided(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
