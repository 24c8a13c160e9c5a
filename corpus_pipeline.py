"""A corpus cleaning pipeline: each stage applies one operator to all that its predecessor kept.

A stage returns the columns of ``documents``; where it changes a text, ``n_chars`` follows.  The
last one returns the packed pieces.  Extra columns pass through; an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common, langid, packing, secrets, simhash, substring


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language go on: not a null or empty text, one without letters, or one that no codeword fits.

    Repeated rows and null ids are judged each by its text.
    """
    common.bounded_batches(spark)
    return langid.accept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group goes on: that with the smallest id, null ids last, of equal rows one.

    Near duplicates have a Jaccard similarity of 0.8 or more in their 5-word shingles; null and empty texts are one group.
    """
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that a document with a smaller id has are cut out; a document left without words by that goes.

    Null and empty texts go on as they are; a null id is larger than every other; rows with one id cut nothing from each other.
    """
    return recounted(substring.strip(docs))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding is replaced by a mark; all documents go on, null texts as null."""
    return recounted(secrets.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences; a null or empty text is one piece of the end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("secret_spans", secret_spans),
    ("sequences", sequences),
]

#: The language classifier and the packing search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs
