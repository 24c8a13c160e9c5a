"""The driver's tables, and CSV visits, as archive events and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VISIT = "type string, host string, city string, visitor string, timestamp long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("space"), F.col("event_type").alias("grouping"), epoch(F.col("ts")).alias("ts"), (F.col("event_id") + 1).alias("seq"), F.col("props").alias("data"), F.create_map(F.lit("type"), "event_type", F.lit("all"), F.lit("")).alias("indexes"))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as timestamps: many ties."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("space"), F.lit("").alias("grouping"), epoch(F.date_trunc("hour", "ts")).alias("ts"), (F.col("event_id") + 1).alias("seq"), F.col("props").alias("data"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("indexes"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("space"), F.col("o_orderstatus").alias("grouping"), epoch(F.col("o_orderdate")).alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("data"), F.create_map(F.lit("cust"), F.col("o_custkey").cast("string")).alias("indexes"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("stream"), (F.col("event_id") + 1).alias("seq"), F.col("props").alias("data"), F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("indexes"))


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("stream"), (F.col("turn") + 1).alias("seq"), F.col("text").alias("data"), F.create_map(F.lit("role"), "role").alias("indexes"))


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of visits with each row as JSON in ``data``; quotes within quotes are doubled, and an empty field is null."""
    rows = spark.read.schema(VISIT).option("escape", '"').csv(path)
    return rows.withColumn("data", F.to_json(F.struct(*rows.columns)))


def visits_as_events(visits: DataFrame) -> DataFrame:
    return visits.select(F.col("type").alias("space"), F.col("host").alias("grouping"), F.col("timestamp").alias("ts"), "seq", "data", F.create_map(F.lit("visitor"), "visitor", F.lit("city"), "city").alias("indexes"))
