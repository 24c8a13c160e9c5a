"""Queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sketch

    return sketch.versions(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.deduplicate(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import pieces

    return pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.columns(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_paragraph_sketch": op1_paragraph_sketch,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_simhash": op3_simhash,
        "op4_secret_scan": op4_secret_scan,
        "op5_packing": op5_packing,
        "op6_toxicity": op6_toxicity,
        "op7_pieces": op7_pieces,
        "op8_media_columns": op8_media_columns,
        "op9_warc": op9_warc,
        "op10_language_id": op10_language_id,
    }


#: The words of every text, their 50-word windows, and the windows that start in a smaller document.
SUBSTRING = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM words, unnest(generate_series(1, len(w) - 49)) AS t(i) WHERE len(w) >= 50
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), starts AS (
  SELECT doc_id, list(i) AS s FROM again GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(s, lambda a: generate_series(a, a + 49)))) AS g FROM starts
), kept AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
         CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


#: Equal payloads are equal html.
WARC = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages
)
"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash with XXH64, tokenise, draw or learn, which SQL cannot express."""
    return {"op2_substring_dedup": SUBSTRING, "op9_warc": WARC}
