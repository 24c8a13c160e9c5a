import corpus_pipeline
import pytest

from tidelog.llm import secrets, substring

from .helpers import table


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, sf_dir).cache()
    return [*out, docs]


def test_stages_keep_columns_and_clean_documents(steps):
    sizes = [s.count() for s in steps]
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert sizes[0] >= sizes[1] >= 0.95 * sizes[0] and sizes[1] >= sizes[2] >= sizes[3] == sizes[4]


def test_decisions_take_effect(steps):
    assert substring.deduplicate(steps[3]).where("n_removed > 0").count() == 0
    for r in steps[4].collect():
        assert not secrets.base_spans(r["text"])
        assert r["n_chars"] == len(r["text"])


def test_run_equals_the_stages(spark, sf_dir, steps):
    pick = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(pick).collect())) == sorted(map(tuple, steps[5].select(pick).collect()))


def test_empty_and_odd_tables(spark, sf_dir):
    rows = [(1, None), (2, ""), (None, "the and of it"), (2, ""), (5, "the cat " * 300)]
    for docs in (table(spark, []), table(spark, rows)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()
