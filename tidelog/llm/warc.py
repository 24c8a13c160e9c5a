"""A content-addressed WARC archive.

Two tables make up an archive: ``payloads`` holds every distinct payload once under its SHA-256,
``headers`` holds the exact header block of every record with that digest.
Joining them gives the original records back.  Of records with equal payloads of
at least ``shared_from`` bytes the one with the largest page_id is the
``response`` and the others are ``revisit`` records that refer to it by its record id.

Reading goes through the records themselves: their bytes are put together again, header fields and blocks are taken from
them, every block is hashed, and a revisit takes its payload's size and digest from the record that it refers to.

A payload that many records have is joined in as many parts as its records need (``PART`` each).

Defined cases: a null html is an empty payload; a null url is an empty target; control characters
in a url (codes 0 to 31 and 127) are percent-encoded; a null page_id is below every other and is written as
``null``; rows with the same payload and the same largest id are all responses, and revisits refer to the first of them; record ids
are unique, also of repeated rows; extra columns are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one payload that are joined in one part.
PART = 1_000_000
CONTROL = [*range(32), 127]
#: First digits of the digests that one round of reading takes.
ROUNDS = ("01234567", "89abcdef")


def record_id(page_id, number):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), number.cast("string"), F.lit(">"))


def header(kind, name, url, length, sha1, refers_to):
    """The header block of one record, with the empty line that ends it."""

    def line(field_name: str, value):
        return F.concat(F.lit(f"{field_name}: "), value, F.lit(CRLF))

    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", name),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", refers_to))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
        F.lit(CRLF),
    )


def encoded(url):
    """Control characters as percent signs and codes."""
    clean = url
    for code in CONTROL:
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike("[\\x00-\\x1F\\x7F]"), clean).otherwise(url)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", shared_from: int = 1000, part: int = PART) -> None:
    """Write the archive's two tables below ``path``, which must not exist."""
    spark = pages.sparkSession
    rows = pages.select(
        common.long_column(pages, page_id).alias("page_id"),
        encoded(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))).alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    named = rows.select(F.monotonically_increasing_id().alias("number"), "page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("length"))
    named = common.materialize(named, "warc-named")  # without the payloads
    with common.released_shuffles(spark):
        # payloads are reduced to one a task before they are shuffled
        rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
        first = named.groupBy("digest").agg(F.max(F.struct("page_id", (-F.col("number")).alias("before"))).alias("last"), F.count("*").alias("n"))
        first = first.select("digest", F.col("last.page_id").alias("last_id"), (-F.col("last.before")).alias("last_number"), "n", F.ceil(F.col("n") / part).cast("int").alias("parts"))
        first = common.materialize(first, "warc-first")
        joined = common.hot_join(named, first, "digest", "n", F.col("number"), part)
        shared = (F.col("length") >= shared_from) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
        kind = F.when(shared, "revisit").otherwise("response")
        block = header(kind, record_id(F.col("page_id"), F.col("number")), F.col("url"), F.col("length"), F.col("sha1"), record_id(F.col("last_id"), F.col("last_number")))
        headers_ = joined.select("page_id", "digest", block.alias("header"), F.pmod(F.col("number"), F.col("parts")).cast("int").alias("part"), "parts")
        headers_.write.option("compression", "zstd").parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``part`` of ``parts``: which copy of its payload a record is joined with."""
    return spark.read.schema("page_id long, digest string, header string, part int, parts int").parquet(f"{path}/headers")


def field(name: str, source="header"):
    return F.regexp_extract(source, rf"\r\n{name}: ([^\r]*)\r\n", 1)


def records(spark: SparkSession, path: str, digits: str | None = None) -> DataFrame:
    """page_id, record: the original record bytes; a revisit's block is empty.  A missing payload leaves a null record.

    ``digits``: only records whose digest begins with one of them.
    """

    def chosen(table: DataFrame) -> DataFrame:
        return table if digits is None else table.where(F.substring("digest", F.lit(1), F.lit(1)).isin(*digits))

    rows = chosen(headers(spark, path)).withColumn("revisit", field("WARC-Type") == "revisit")
    own = F.col("header").cast("binary")
    end = F.lit(b"\r\n\r\n")
    empty = rows.where("revisit").select("page_id", F.concat(own, end).alias("record"))
    full = rows.where("not revisit")
    needed = full.where("parts > 1").select("digest", "parts").distinct()
    stored = chosen(payloads(spark, path)).join(needed, "digest", "left").select("digest", "payload", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    joined = full.join(stored, ["digest", "part"], "left").select("page_id", F.concat(own, F.col("payload"), end).alias("record"))
    return empty.unionByName(joined)


def parsed(records_: DataFrame) -> DataFrame:
    """page_id and what a record's bytes say: id, kind, stated digest, refers_to, and size and SHA-1 of its block."""
    # the header ends at the first empty line; field values have no line breaks
    at = F.instr(F.col("text"), "\r\n\r\n") + 3
    rows = records_.withColumn("text", F.decode(F.substring("record", F.lit(1), F.lit(1 << 20)), "ISO-8859-1")).withColumn("at", at)
    head = F.substring("text", F.lit(1), F.col("at"))
    rows = rows.withColumn("head", head).withColumn("block", F.substring("record", F.col("at") + 1, F.octet_length("record") - F.col("at") - 4))
    whole = (field("Content-Length", "head").cast("bigint") == F.octet_length("block")) & (F.substring("record", F.octet_length("record") - 3, F.lit(4)) == F.lit(b"\r\n\r\n"))
    return rows.select(
        "page_id",
        field("WARC-Record-ID", "head").alias("id"),
        field("WARC-Type", "head").alias("record_type"),
        field("WARC-Payload-Digest", "head").alias("stated"),
        field("WARC-Refers-To", "head").alias("refers"),
        F.octet_length("block").cast("bigint").alias("size"),
        F.sha1("block").alias("found"),
        F.coalesce(whole, F.lit(False)).alias("whole"),
    )


def read(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all from the records that are put together again.

    A missing payload, or one that does not match a record's digest or length, stops the query.
    Records are put together in rounds by their digests' first digit, so that a round's shuffle files are gone before the next one's are written.
    """
    rounds = [common.materialize(parsed(records(spark, path, digits)), "warc-records") for digits in ROUNDS]  # without the payloads
    rows = reduce(DataFrame.unionByName, rounds)
    fault = F.raise_error(F.lit("a stored payload is missing or does not match its record"))

    def checked(size, found):
        right = F.col("whole") & (F.col("stated") == F.concat(F.lit("sha1:"), found))
        return size.alias("payload_bytes"), F.when(right, found).otherwise(fault).alias("payload_digest")

    responses = rows.where("record_type = 'response'").select("page_id", *checked(F.col("size"), F.col("found")), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    revisits = rows.where("record_type <> 'response' or record_type is null")
    wanted = revisits.groupBy("refers").agg(F.count("*").alias("n"))
    targets = rows.where("record_type = 'response'").select("id", "size", "found").join(wanted, F.col("id") == F.col("refers")).select("refers", "n", F.col("size").alias("full_size"), F.col("found").alias("full_found"))
    joined = common.hot_join(revisits, common.materialize(targets, "warc-targets"), "refers", "n", F.xxhash64("id"), part, "left")
    referred = F.regexp_extract("refers", r"^<urn:page:(-?\d+):\d+>$", 1).cast("bigint")
    joined = joined.select("page_id", *checked(F.col("full_size"), F.col("full_found")), "record_type", referred.alias("refers_to"))
    return responses.unionByName(joined)


def archive(pages: DataFrame, shared_from: int = 1000) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write(pages, path, shared_from=shared_from)
    return read(spark, path)
