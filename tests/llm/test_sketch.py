import hashlib
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tidelog.llm import sketch

from .helpers import rows_of, table


def brute(rows):
    """Versions by plain Python; likeness from multisets of paragraphs."""

    def like(a, b):
        x, y = Counter(a.split("\n")), Counter(b.split("\n"))
        return sum((x & y).values()) / sum((x | y).values())

    order = sorted([(i, t or "") for i, t in rows], key=lambda r: -(10**19) if r[0] is None else r[0], reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(t, edited), like(t, after))
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, near_edited, near_next = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - near_edited) < 1e-12 and abs(r["near_next"] - near_next) < 1e-12


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(rows_of(sketch.versions(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_texts(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (None, "é\n𝒳𝒳\n"), (4, "\n" * 50), (5, "a\nb\na\nb\na"), (6, "x"), (70, "\n".join(str(rng.random()) for _ in range(400))), (71, "\n".join(str(rng.random()) for _ in range(600)))]
    got = rows_of(sketch.versions(table(spark, rows)))
    check(got, rows)
    again = [(i + 100, "same\ntext") for i in range(5)] + [(9, "same\ntext")]
    assert len({r["fingerprint"] for r in rows_of(sketch.versions(table(spark, again)))}) == 1


def test_one_row_repeated_rows_and_empty(spark):
    check(rows_of(sketch.versions(table(spark, [(3, "abc\ndef")]))), [(3, "abc\ndef")])
    assert sketch.versions(table(spark, [(3, "abc"), (3, "abc"), (3, "abd")])).count() == 3
    assert sketch.versions(table(spark, [])).count() == 0


def test_peeling_recovers_counts_and_reports_failure(spark):
    df = spark.range(1).select(F.array(*[F.lit(i).cast("bigint") for i in range(100)]).alias("a"), F.array(*[F.lit(i).cast("bigint") for i in range(90, 130)]).alias("b"))
    for size, ok in ((100, True), (4, False)):
        s = F.lit(size)
        r = df.select(sketch.peel(sketch.difference(sketch.cells(F.col("a"), s), sketch.cells(F.col("b"), s)), s).alias("r")).first()["r"]
        assert r["done"] == ok
        if ok:
            assert (r["only_a"], r["only_b"]) == (90, 30)


def test_texts_of_many_paragraphs_take_seconds(spark):
    rng = random.Random(4)
    rows = [(k, "\n".join(f"{rng.randrange(30_000)} line" for _ in range(50_000))) for k in range(2)]
    df = table(spark, rows).repartition(1)
    began = time.perf_counter()
    got = rows_of(sketch.versions(df))
    took = time.perf_counter() - began
    check(got, rows)
    assert took < 60


def test_digests_are_compared_where_every_sketch_gets_stuck(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RETRIES", 1)
    monkeypatch.setattr(sketch, "CELLS", 1)
    monkeypatch.setattr(sketch, "ROUNDS", 1)
    rows = [(1, "\n".join(str(i) for i in range(300))), (2, "\n".join(str(i) for i in range(200, 900))), (3, "x. y. " * 100)]
    check(rows_of(sketch.versions(table(spark, rows))), rows)


def test_no_python_on_executors(spark, sf_dir):
    plan = sketch.versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "SinglePartition"))
