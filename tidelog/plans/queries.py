"""The registry of the library's queries over the driver's tables, with the SQL each one must equal.

Every ordering query puts out its positions, so that the order itself is compared.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import ordering, streams
from ..operators.archive import ArchiveView, foreach_event
from ..operators.kv import SortedTable
from ..sources import exchange, files, stream_store, tables
from ..sources.archive_store import Archive, ArchiveWriter
from ..sources.stream_store import StreamLog
from ..streaming import linker

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def register(function):
        REGISTRY[function.__name__] = (function, sql)
        return function

    return register


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; it is deleted when the session ends.

    Only a local session, as in tests, may leave the setting away.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tidelog/{tag}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        files.delete(spark, path)


EVENTS = """SELECT CAST(user_id AS VARCHAR) AS space, event_type AS "grouping", CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  event_id + 1 AS seq, props AS data, event_type, user_id FROM events"""
ORDERS = """SELECT o_orderpriority AS space, o_orderstatus AS "grouping", CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts,
  o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS data FROM orders"""
TYPES = """SELECT event_type AS space, '' AS "grouping", CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS ts,
  event_id + 1 AS seq, props AS data, CAST(user_id AS VARCHAR) AS usr FROM events"""
LOG = """SELECT event_id + 1 AS seq, 'type:' || event_type AS index_key, props AS data FROM events
  UNION ALL SELECT event_id + 1, 'user:' || CAST(user_id AS VARCHAR), props FROM events"""
SCAN = "row_number() OVER (PARTITION BY space, \"grouping\" ORDER BY ts DESC, seq)"


# Catalog


@query("SELECT space, row_number() OVER (ORDER BY space) AS pos FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS space FROM events)")
def space_list(spark, sf_dir):
    from pyspark.sql.window import Window

    # as many rows as there are spaces; numbered within ranges of the first letters
    spaces = ArchiveView(tables.events_by_user(spark, sf_dir)).spaces().withColumn("head", F.substring("space", 1, 1))
    before = spaces.groupBy("head").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spaces.join(before, "head").select("space", (F.col("base") + F.row_number().over(Window.partitionBy("head").orderBy("space"))).alias("pos"))


@query(f"SELECT count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM ({EVENTS}) WHERE user_id = 8")
def space_find(spark, sf_dir):
    return ArchiveView(tables.events_by_user(spark, sf_dir)).space("8").events.agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query('SELECT "grouping", row_number() OVER (ORDER BY "grouping") AS pos FROM (SELECT DISTINCT event_type AS "grouping" FROM events WHERE user_id = 8)')
def grouping_list(spark, sf_dir):
    from pyspark.sql.window import Window

    found = ArchiveView(tables.events_by_user(spark, sf_dir)).space("8")
    return found.events.select("space", "grouping").distinct().select("grouping", F.row_number().over(Window.partitionBy("space").orderBy("grouping")).cast("bigint").alias("pos"))


@query("SELECT name FROM (VALUES ('all'), ('type')) AS t(name) WHERE EXISTS (SELECT 1 FROM events WHERE user_id = 8)")
def index_list(spark, sf_dir):
    return ArchiveView(tables.events_by_user(spark, sf_dir)).space("8").index_names()


# Archive scans


def placed(rows: DataFrame, ascending: bool = False) -> DataFrame:
    return ordering.scan_positions(rows, ["space", "grouping"], ascending).select("space", "grouping", "ts", "seq", "data", "pos")


@query(f"SELECT space, \"grouping\", ts, seq, data, {SCAN} AS pos FROM ({EVENTS}) WHERE user_id = 8 AND \"grouping\" = 'click'")
def archive_scan(spark, sf_dir):
    return placed(ArchiveView(tables.events_by_user(spark, sf_dir)).space("8").scan("click"))


@query(f'SELECT space, "grouping", ts, seq, data, {SCAN} AS pos FROM ({EVENTS})')
def archive_scan_all(spark, sf_dir):
    return placed(tables.events_by_user(spark, sf_dir))


@query(f'SELECT space, "grouping", ts, seq, data, {SCAN} AS pos FROM ({ORDERS})')
def archive_scan_ties(spark, sf_dir):
    return placed(tables.orders(spark, sf_dir))


@query("SELECT CAST(0 AS BIGINT) AS n")
def archive_scan_missing(spark, sf_dir):
    view = ArchiveView(tables.events_by_user(spark, sf_dir))
    return view.space("no such space").scan("click").unionByName(view.space("8").scan("no such grouping")).agg(F.count("*").alias("n"))


def placed_index(rows: DataFrame, ascending: bool = False) -> DataFrame:
    return ordering.scan_positions(rows, ["space", "index_key"], ascending).select("space", "index_key", "ts", "seq", "grouping", "data", "pos")


@query(f"""SELECT space, 'user:8' AS index_key, ts, seq, "grouping", data, row_number() OVER (ORDER BY ts DESC, seq) AS pos FROM ({TYPES}) WHERE space = 'click' AND usr = '8'""")
def archive_scan_index(spark, sf_dir):
    return placed_index(ArchiveView(tables.events_by_type(spark, sf_dir)).space("click").scan_index("user", "8"))


@query(f"""SELECT space, 'user:8' AS index_key, ts, seq, "grouping", data, row_number() OVER (ORDER BY ts, seq DESC) AS pos FROM ({TYPES}) WHERE space = 'click' AND usr = '8'""")
def archive_scan_index_rev(spark, sf_dir):
    return placed_index(ArchiveView(tables.events_by_type(spark, sf_dir)).space("click").scan_index("user", "8", ascending=True), True)


@query(f"""SELECT space, 'all:' AS index_key, ts, seq, "grouping", data, row_number() OVER (ORDER BY ts DESC, seq) AS pos FROM ({EVENTS}) WHERE user_id = 8""")
def archive_scan_space(spark, sf_dir):
    return placed_index(ArchiveView(tables.events_by_user(spark, sf_dir)).space("8").scan_index("all", ""))


@query(f"SELECT * FROM (SELECT space, ts, seq, data, row_number() OVER (ORDER BY ts DESC, seq) AS pos FROM ({TYPES}) WHERE space = 'click') WHERE pos <= 500")
def archive_scan_limit(spark, sf_dir):
    found = ArchiveView(tables.events_by_type(spark, sf_dir)).space("click").scan("", limit=500)
    return placed(found).select("space", "ts", "seq", "data", "pos")


def top(k: int) -> str:
    return f'SELECT * FROM (SELECT space, "grouping", ts, seq, data, {SCAN} AS pos FROM ({ORDERS})) WHERE pos <= {k}'


@query(top(1))
def archive_first_per_grouping(spark, sf_dir):
    return ordering.top_k(tables.orders(spark, sf_dir), ["space", "grouping"], 1).drop("indexes")


@query(f"SELECT * FROM (SELECT space, ts, seq, data, row_number() OVER (PARTITION BY space ORDER BY ts DESC, seq) AS pos FROM ({ORDERS})) WHERE pos <= 3")
def archive_topk_per_space(spark, sf_dir):
    return ordering.top_k(tables.orders(spark, sf_dir), ["space"], 3).select("space", "ts", "seq", "data", "pos")


@query(f"""SELECT space, "grouping", ts, seq, data, pos FROM (SELECT *, coalesce(sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) OVER
  (PARTITION BY space, "grouping" ORDER BY ts DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops, {SCAN} AS pos FROM ({ORDERS})) WHERE stops = 0""")
def archive_take_while(spark, sf_dir):
    return ordering.take_while(tables.orders(spark, sf_dir), ["space", "grouping"], F.col("seq") % 50 == 0).drop("indexes")


@query(f"""SELECT space, "grouping", ts, seq, data FROM (SELECT *, sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) OVER
  (PARTITION BY space, "grouping" ORDER BY ts DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stops FROM ({ORDERS})) WHERE stops = 0""")
def archive_terminator_compat(spark, sf_dir):
    rows = tables.orders(spark, sf_dir).withColumn("data", F.when(F.col("seq") % 50 == 0, F.lit("")).otherwise(F.col("data")))
    return ordering.until_empty(rows, ["space", "grouping"]).select("space", "grouping", "ts", "seq", "data")


@query("SELECT event_id + 1 AS seq, (CAST(floor(epoch(ts)) AS BIGINT) - 3000000000) & 4294967295 AS ts FROM events")
def archive_ts_u32(spark, sf_dir):
    return tables.events_by_user(spark, sf_dir).select("seq", keys.unsigned_32(F.col("ts") - 3000000000).alias("ts"))


def stored(spark: SparkSession, events: DataFrame) -> Archive:
    path = scratch(spark, "archive")
    writer = ArchiveWriter(spark, path)
    writer.add(events)
    writer.write()
    return Archive.open(spark, path)


@query(f'SELECT space, "grouping", ts, seq, data, {SCAN} AS pos FROM ({EVENTS})')
def archive_roundtrip(spark, sf_dir):
    return placed(stored(spark, tables.events_by_user(spark, sf_dir)).events)


@query(f'SELECT space, "grouping", ts, seq, data, {SCAN} AS pos FROM ({EVENTS})')
def archive_flush(spark, sf_dir):
    """Two spaces are flushed before the rest is written; every space comes back."""
    events, path = tables.events_by_user(spark, sf_dir), scratch(spark, "archive")
    writer = ArchiveWriter(spark, path)
    writer.add(events)
    for space in ("8", "3", "no such space"):
        writer.flush(space)
    writer.write()
    archive = Archive.open(spark, path)
    flushed = archive.space("8").events.unionByName(archive.space("3").events)
    rest = archive.rest.events
    archive.close()
    return placed(flushed.unionByName(rest, allowMissingColumns=True))


@query(f"""SELECT space, 'type:click' AS index_key, ts, seq, "grouping", data, row_number() OVER (ORDER BY ts DESC, seq) AS pos FROM ({EVENTS}) WHERE user_id = 8 AND event_type = 'click'""")
def archive_roundtrip_index(spark, sf_dir):
    return placed_index(stored(spark, tables.events_by_user(spark, sf_dir)).space("8").scan_index("type", "click"))


@query("SELECT event_id + 1 AS seq, CAST(2 AS BIGINT) AS listed, CAST(1 AS BIGINT) AS linked FROM events")
def index_key_collision(spark, sf_dir):
    both = F.create_map(F.lit("a:b"), F.lit("c"), F.lit("a"), F.lit("b:c"))
    log = tables.event_log(spark, sf_dir).withColumn("indexes", both)
    counted = log.select("seq", F.size(keys.index_keys(F.col("indexes"))).cast("bigint").alias("listed"))
    linked = streams.entries(log).groupBy("seq").agg(F.count("*").alias("linked"))
    return counted.join(linked, "seq")


@query("""SELECT CAST(user_id AS VARCHAR) AS space, 'type:' || event_type AS index_key, event_id + 1 AS seq, event_type AS "grouping" FROM events
  UNION ALL SELECT CAST(user_id AS VARCHAR), 'all:', event_id + 1, event_type FROM events""")
def postings(spark, sf_dir):
    return ArchiveView(tables.events_by_user(spark, sf_dir)).postings.select("space", "index_key", "seq", "grouping")


GAPS = """SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS space, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS "grouping",
  CASE WHEN event_id % 4 = 1 THEN NULL ELSE CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) END AS ts, CASE WHEN event_id % 997 = 5 THEN NULL ELSE event_id + 1 END AS seq,
  event_id AS id FROM events"""
GAP_ORDER = 'OVER (PARTITION BY space, "grouping" ORDER BY ts DESC NULLS LAST, seq NULLS FIRST, id'


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls in keys, times and sequence, and columns named like those used inside."""
    e = tables.table(spark, sf_dir, "events")
    some = F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string"))
    return e.select(some.alias("space"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("grouping"), F.when(F.col("event_id") % 4 != 1, tables.epoch(F.date_trunc("day", "ts"))).alias("ts"), F.when(F.col("event_id") % 997 != 5, F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("block"), F.col("event_id").alias("_side_0"))


#: Rows that are equal in keys, ts and seq may swap their positions: what is compared of them is the set of positions.
@query(f'SELECT space, "grouping", ts, seq, row_number() {GAP_ORDER}) AS pos FROM ({GAPS})')
def archive_scan_nulls(spark, sf_dir):
    return ordering.scan_positions(gaps(spark, sf_dir), ["space", "grouping"]).select("space", "grouping", "ts", "seq", "pos")


@query(f"""SELECT space, "grouping", ts, seq, pos FROM (SELECT *, row_number() {GAP_ORDER}) AS pos,
  coalesce(sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) {GAP_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM ({GAPS})) WHERE stops = 0""")
def archive_take_while_nulls(spark, sf_dir):
    return ordering.take_while(gaps(spark, sf_dir), ["space", "grouping"], F.col("seq") % 50 == 0).select("space", "grouping", "ts", "seq", "pos")


@query(f'SELECT space, "grouping", seq, CASE WHEN seq IS NULL THEN 0 ELSE coalesce(lag(seq) OVER (PARTITION BY space, "grouping" ORDER BY seq NULLS FIRST), 0) END AS prev FROM ({GAPS})')
def stream_next_nulls(spark, sf_dir):
    return ordering.previous(gaps(spark, sf_dir), ["space", "grouping"]).select("space", "grouping", "seq", "prev")


@query(f"SELECT seq, ts, row_number() OVER (ORDER BY ts DESC, seq) AS pos FROM ({TYPES}) WHERE space = 'click' QUALIFY pos <= 7")
def archive_visitor(spark, sf_dir):
    """A callback that stops at the seventh event, which it still gets."""
    seen = []
    foreach_event(ArchiveView(tables.events_by_type(spark, sf_dir)).space("click").scan("").select("seq", "ts"), lambda r: seen.append((r["seq"], r["ts"], len(seen) + 1)) or len(seen) < 7)
    return spark.createDataFrame(seen, "seq long, ts long, pos long")


# Streams


@query("SELECT event_id + 1 AS seq, props AS data, row_number() OVER (ORDER BY event_id) AS pos FROM events")
def stream_iterate(spark, sf_dir):
    return ordering.positions(streams.iterate(tables.event_log(spark, sf_dir)), ["stream"], "seq", [F.asc("seq")], False).select("seq", "data", "pos")


@query("SELECT event_id + 1 AS seq, event_id - 298 AS pos, CAST(350 AS BIGINT) AS cursor FROM events WHERE event_id BETWEEN 299 AND 348")
def stream_iterate_resume(spark, sf_dir):
    got = streams.iterate(tables.event_log(spark, sf_dir), 300, 50)
    pos = ordering.positions(got, ["stream"], "seq", [F.asc("seq")], False).select("seq", "pos")
    return pos.withColumn("cursor", F.lit(streams.next_cursor(got, 300).first()["cursor"]).cast("bigint"))


@query(f"SELECT index_key, max(seq) AS tail FROM ({LOG}) GROUP BY index_key")
def stream_first(spark, sf_dir):
    return streams.tails(tables.event_log(spark, sf_dir)).select("index_key", "tail")


NEXT = f"SELECT seq, index_key, coalesce(lag(seq) OVER (PARTITION BY index_key ORDER BY seq), 0) AS prev FROM ({LOG})"


@query(NEXT)
def stream_next(spark, sf_dir):
    return streams.links(tables.event_log(spark, sf_dir)).select("seq", "index_key", "prev")


@query("SELECT event_id + 1 AS seq, props AS data, row_number() OVER (ORDER BY event_id DESC) AS pos FROM events WHERE event_type = 'click'")
def stream_scan_index(spark, sf_dir):
    found = streams.scan_index(tables.event_log(spark, sf_dir), "type", "click")
    return ordering.positions(found, ["stream"], "seq", [F.desc("seq")], True).select("seq", "data", "pos")


@query("""WITH c AS (SELECT event_id + 1 AS seq FROM events WHERE event_type = 'click' AND event_id + 1 <= 800),
  d AS (SELECT seq, row_number() OVER (ORDER BY seq DESC) AS pos FROM c)
  SELECT seq, pos, (SELECT coalesce(max(seq), 0) FROM d WHERE pos > 20) AS cursor FROM d WHERE pos <= 20""")
def stream_scan_index_resume(spark, sf_dir):
    log = tables.event_log(spark, sf_dir)
    got = streams.scan_index(log, "type", "click", 800, 20)
    pos = ordering.positions(got, ["stream"], "seq", [F.desc("seq")], True).select("seq", "pos")
    last = got.agg(F.min("seq")).first()[0]
    older = streams.links(log).where((F.col("index_key") == "type:click") & (F.col("seq") == last)).first()
    return pos.withColumn("cursor", F.lit(older["prev"] if older else 0).cast("bigint"))


@query("SELECT max(event_id) + 2 AS cursor FROM events")
def stream_offset(spark, sf_dir):
    return streams.next_cursor(tables.event_log(spark, sf_dir), 0)


MERGED = """SELECT row_number() OVER (ORDER BY part, event_id) AS seq, props AS data, event_type, user_id FROM
  (SELECT *, CASE WHEN event_id >= 600 THEN 0 ELSE 1 END AS part FROM events)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    late = log.where("seq > 600").withColumn("seq", F.col("seq") - 600)
    return streams.merge([late, log.where("seq <= 600")], "merged")


@query(f"SELECT seq, data FROM ({MERGED})")
def stream_merge(spark, sf_dir):
    return merged(spark, sf_dir).select("seq", "data")


@query(f"SELECT seq, lag(seq, 1, 0) OVER (ORDER BY seq) AS prev, row_number() OVER (ORDER BY seq DESC) AS pos FROM ({MERGED}) WHERE user_id = 8")
def stream_merge_scan_index(spark, sf_dir):
    log = merged(spark, sf_dir)
    chain = streams.links(log).where("index_key = 'user:8'")
    return ordering.positions(chain, ["stream"], "seq", [F.desc("seq")], True).select("seq", "prev", "pos")


@query("""SELECT event_id + 1 AS seq, 'a' AS name, 'b:' || event_type AS value FROM events
  UNION ALL SELECT event_id + 1, 'user', CAST(user_id AS VARCHAR) FROM events""")
def stream_indexes(spark, sf_dir):
    own = tables.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.array(F.concat(F.lit("a:b:"), "event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("keys"))
    return own.select("seq", F.explode(keys.indexes_of(F.col("keys"))).alias("name", "value"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream, turn + 1 AS seq, 'role:' || role AS index_key,
  coalesce(lag(turn + 1) OVER (PARTITION BY conv_id, role ORDER BY turn), 0) AS prev FROM conversations""")
def stream_conv_chain(spark, sf_dir):
    return streams.links(tables.conversation_logs(spark, sf_dir)).select("stream", "seq", "index_key", "prev")


def log_files(spark: SparkSession, sf_dir: str, parts: int = 3, files_each: int = 4) -> tuple[str, DataFrame]:
    """The event log as directories of files, written in sequence order, ``files_each`` files a part."""
    path, log = scratch(spark, "log"), tables.event_log(spark, sf_dir)
    n = log.agg(F.max("seq")).first()[0]
    for k in range(parts):
        some = log.where((F.col("seq") > n * k // parts) & (F.col("seq") <= n * (k + 1) // parts))
        some.repartition(files_each).write.mode("append").parquet(path)
    return path, log


@query(f"SELECT index_key, max(seq) AS tail FROM ({LOG}) GROUP BY index_key")
def stream_tails_streaming(spark, sf_dir):
    path, log = log_files(spark, sf_dir)
    target = scratch(spark, "tails")
    linker.tails_query(linker.read_log(spark, path, log.schema, 4), target, scratch(spark, "checkpoint")).awaitTermination()
    return linker.tails(spark, target).select("index_key", "tail")


@query(NEXT)
def stream_append_streaming(spark, sf_dir):
    path, log = log_files(spark, sf_dir)
    target = scratch(spark, "linked")
    linker.link_batches(linker.read_log(spark, path, log.schema, 4), target, scratch(spark, "checkpoint")).awaitTermination()
    return linker.links(spark, target).select("seq", "index_key", "prev")


# Stored logs


def stored_log(spark: SparkSession, sf_dir: str, cut: int = 600) -> StreamLog:
    """The event log, appended in two parts; the second through a handle of its own."""
    path, log = scratch(spark, "stored-log"), tables.event_log(spark, sf_dir)
    StreamLog.create(spark, path, "events").append(log.where(F.col("seq") <= cut))
    StreamLog.open(spark, path).append(log.where(F.col("seq") > cut).withColumn("seq", F.col("seq") - cut))
    return StreamLog.open(spark, path)


@query("SELECT event_id + 1 AS seq, props AS data, row_number() OVER (ORDER BY event_id) AS pos FROM events")
def stream_log_iterate(spark, sf_dir):
    return ordering.positions(stored_log(spark, sf_dir).iterate(), ["stream"], "seq", [F.asc("seq")], False).select("seq", "data", "pos")


@query(NEXT)
def stream_log_links(spark, sf_dir):
    return stored_log(spark, sf_dir).postings().select("seq", "index_key", "prev")


@query("""SELECT event_id + 1 AS seq, lag(event_id + 1, 1, 0) OVER (ORDER BY event_id) AS prev, props AS data, row_number() OVER (ORDER BY event_id DESC) AS pos FROM events WHERE event_type = 'click'""")
def stream_log_scan_index(spark, sf_dir):
    log = stored_log(spark, sf_dir)
    log.seal()
    found = StreamLog.open(spark, log.path).scan_index("type", "click")
    return ordering.positions(found, ["stream"], "seq", [F.desc("seq")], True).select("seq", "prev", "data", "pos")


@query(f"SELECT index_key, max(seq) AS tail FROM ({LOG}) GROUP BY index_key")
def stream_log_tails(spark, sf_dir):
    log = stored_log(spark, sf_dir)
    log.seal()
    return StreamLog.open(spark, log.path).tails().select("index_key", "tail")


@query("""SELECT step, closed, "offset", length, newest FROM (VALUES (1, false, 0, 0, 0), (2, false, 600, 600, 600), (3, false, -1, -1, -1), (4, true, -1, -1, -1)) AS t(step, closed, o, l, n),
  (SELECT count(*) AS rows, max(event_id) + 1 AS top FROM events), (SELECT max(event_id) + 1 AS before FROM events WHERE event_type = 'click' AND event_id < 600), (SELECT max(event_id) + 1 AS after FROM events WHERE event_type = 'click'),
  LATERAL (SELECT CAST(CASE WHEN o < 0 THEN top ELSE o END AS BIGINT) AS "offset", CAST(CASE WHEN l < 0 THEN rows ELSE l END AS BIGINT) AS length, CAST(CASE step WHEN 1 THEN 0 WHEN 2 THEN before ELSE after END AS BIGINT) AS newest)""")
def stream_log_state(spark, sf_dir):
    """Closed flag, offset, length and newest click of a log: new, appended to, reopened and appended to, sealed and reopened."""
    path, log, seen = scratch(spark, "stored-log"), tables.event_log(spark, sf_dir), []

    def note(handle: StreamLog) -> None:
        seen.append((len(seen) + 1, handle.closed, handle.offset, handle.length, handle.first("type", "click")))

    one = StreamLog.create(spark, path)
    note(one)
    one.append(log.where("seq <= 600"))
    note(one)
    two = StreamLog.open(spark, path)
    two.append(log.where("seq > 600").withColumn("seq", F.col("seq") - 600))
    note(two)
    two.close()
    two.close()
    note(StreamLog.open(spark, path))
    return spark.createDataFrame(seen, "step int, closed boolean, offset long, length long, newest long")


@query("SELECT event_id + 1 AS seq, props AS data FROM events")
def stream_log_recovery(spark, sf_dir):
    """A refused append and a torn one between two good ones."""
    path, log = scratch(spark, "stored-log"), tables.event_log(spark, sf_dir)
    StreamLog.create(spark, path).append(log.where("seq <= 600"))
    rest = log.where("seq > 600").withColumn("seq", F.col("seq") - 600)
    with contextlib.suppress(ValueError):
        StreamLog.open(spark, path).append(rest.withColumn("seq", F.col("seq") + 5))
    rest.write.parquet(f"{path}/append-1-torn/events")
    reopened = StreamLog.open(spark, path)
    reopened.append(rest)
    reopened.recover()
    return StreamLog.open(spark, path).events().select("seq", "data")


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) AS seq, props AS data FROM events")
def stream_log_order(spark, sf_dir):
    """Events without a sequence, appended in the order of two columns."""
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("props").alias("data"), F.create_map(F.lit("type"), "event_type").alias("indexes"))
    log = StreamLog.create(spark, scratch(spark, "stored-log"))
    log.append(e, ["user_id", "event_id"])
    return log.events().select("seq", "data")


@query(f"SELECT seq, lag(seq, 1, 0) OVER (ORDER BY seq) AS prev, row_number() OVER (ORDER BY seq DESC) AS pos FROM ({MERGED}) WHERE user_id = 8")
def stream_log_merge(spark, sf_dir):
    log, paths = tables.event_log(spark, sf_dir), [scratch(spark, "stored-log") for _ in range(2)]
    StreamLog.create(spark, paths[0]).append(log.where("seq > 600").withColumn("seq", F.col("seq") - 600))
    StreamLog.create(spark, paths[1]).append(log.where("seq <= 600"))
    StreamLog.open(spark, paths[1]).seal()
    one = stream_store.merge(spark, scratch(spark, "stored-log"), paths)
    return ordering.positions(one.scan_index("user", "8"), ["stream"], "seq", [F.desc("seq")], True).select("seq", "prev", "pos")


# Byte layouts


@query("""SELECT event_id + 1 AS seq, CAST(4 + 1 + octet_length(encode(props)) + 1 + 1 + octet_length(encode('type:' || event_type)) + CASE WHEN event_id < 128 THEN 1 WHEN event_id < 16384 THEN 2 ELSE 3 END AS BIGINT) AS bytes,
  lower(hex(encode(props))) AS data FROM events""")
def stream_serialize(spark, sf_dir):
    """Records of one index entry whose older offset is the event's id; the data stand after the two lengths."""
    e = tables.table(spark, sf_dir, "events")
    key = F.concat(F.lit("type:"), "event_type")
    record = exchange.serialized(F.col("props"), F.create_map(F.lit("type"), "event_type"), F.create_map(key, F.col("event_id")))
    return e.select((F.col("event_id") + 1).alias("seq"), record.alias("r"), F.octet_length("props").alias("n")).select("seq", F.octet_length("r").cast("bigint").alias("bytes"), F.lower(F.hex(F.substring("r", F.lit(6), F.col("n")))).alias("data"))


@query("""SELECT conv_id, turn, sha256(text) AS whole, lower(hex(encode(substring(text, 65, 8)))) AS peek FROM conversations WHERE text = regexp_replace(text, '[^ -~]', '', 'g')""")
def block_seek(spark, sf_dir):
    """Texts in blocks of 64 bytes: read back whole, and 8 bytes from the second block on."""
    c = tables.table(spark, sf_dir, "conversations").where("text = regexp_replace(text, '[^ -~]', '')")
    stored = c.select("conv_id", "turn", exchange.blocked(F.col("text"), 64).alias("b"))
    return stored.select("conv_id", "turn", F.sha2(exchange.unblocked(F.col("b"), 64), 256).alias("whole"), F.lower(F.hex(exchange.unblocked(F.col("b"), 64, 1, 8))).alias("peek"))


@query(f"SELECT space AS path, space, ts, data, 'user:' || usr AS keys, row_number() OVER (PARTITION BY space ORDER BY ts DESC, seq) AS pos FROM ({TYPES})")
def exchange_archive(spark, sf_dir):
    """One archive file of each event type, in parts, and what is read back from the files."""
    path = scratch(spark, "archive-files")
    with files.released_shuffles(spark):
        exchange.archive_parts(tables.events_by_type(spark, sf_dir).withColumn("path", F.col("space")), "path").write.parquet(path)
    found = exchange.read_archive_parts(spark.read.parquet(path))
    return found.select("path", "space", "ts", F.col("data").cast("string").alias("data"), F.array_join("keys", ",").alias("keys"), "pos")


CHAIN = """SELECT CAST(conv_id AS VARCHAR) AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, text AS data,
  'role:' || role AS index_key FROM conversations"""


@query(f"SELECT stream, seq, data, index_key, coalesce(lag(seq) OVER (PARTITION BY stream, index_key ORDER BY seq), 0) AS prev FROM ({CHAIN})")
def exchange_log(spark, sf_dir):
    """One log file of each conversation; the byte offsets read back are turned into sequence numbers by their records."""
    path = scratch(spark, "log-files")
    exchange.log_files(tables.conversation_logs(spark, sf_dir)).write.parquet(path)
    rows = exchange.read_logs(spark.read.parquet(path))
    each = rows.select("path", "seq", F.col("data").cast("string").alias("data"), F.explode("prev").alias("index_key", "older"))
    places = rows.select("path", F.col("offset").alias("older"), F.col("seq").alias("prev"))
    return each.join(places, ["path", "older"], "left").select(F.col("path").alias("stream"), "seq", "data", "index_key", F.coalesce("prev", F.lit(0)).alias("prev"))


@query(f"SELECT stream, seq, data FROM (SELECT *, max(seq) OVER (PARTITION BY stream) AS top FROM ({CHAIN})) WHERE seq < top")
def exchange_log_torn(spark, sf_dir):
    """Open log files whose last byte is missing: the last record is left out."""
    files_ = exchange.log_files(tables.conversation_logs(spark, sf_dir), seal=False)
    torn = files_.withColumn("content", F.expr("substring(content, 1, octet_length(content) - 1)"))
    return exchange.read_logs(torn, "DROP_TAIL").select(F.col("path").alias("stream"), "seq", F.col("data").cast("string").alias("data"))


# Sorted tables and CSV


def customers(spark: SparkSession, sf_dir: str) -> SortedTable:
    return SortedTable(tables.table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value")))


@query("SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def kv_get(spark, sf_dir):
    table = customers(spark, sf_dir)
    return table.lookup(table.rows.agg(F.min("key")).first()[0])


@query("SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_name >= 'Customer#000000050'")
def kv_find(spark, sf_dir):
    return customers(spark, sf_dir).find("Customer#000000050")


def built(spark: SparkSession, sf_dir: str) -> SortedTable:
    path = scratch(spark, "sorted-table")
    SortedTable.build(customers(spark, sf_dir).rows.select(F.col("key").cast("binary").alias("key"), "value"), path)
    return SortedTable.open(spark, path)


@query("SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def sorted_table_get(spark, sf_dir):
    table = built(spark, sf_dir)
    found = table.lookup(bytearray(table.rows.agg(F.max("key")).first()[0]))
    return found.select(F.col("key").cast("string").alias("key"), "value")


@query("SELECT c_name AS key, c_custkey AS value, row_number() OVER (ORDER BY c_name) AS pos FROM customer WHERE c_name >= 'Customer#00000005'")
def sorted_table_find(spark, sf_dir):
    found = built(spark, sf_dir).find(bytearray(b"Customer#00000005")).withColumn("id", F.substring_index(F.col("key").cast("string"), "#", -1).cast("bigint"))
    return ordering.positions(found, [], "id", [F.asc("id")], False).select(F.col("key").cast("string").alias("key"), "value", "pos")


@query("SELECT event_type AS type, CAST(user_id AS VARCHAR) AS host, 'x, \"y\"' AS city, CAST(event_id AS VARCHAR) AS visitor, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events")
def csv_load(spark, sf_dir):
    """Visits through a CSV file with quotes and commas, and back from the JSON that the loader makes of each row."""
    path, e = scratch(spark, "csv"), tables.table(spark, sf_dir, "events")
    visits = e.select("event_type", F.col("user_id").cast("string"), F.lit('x, "y"'), F.col("event_id").cast("string"), tables.epoch(F.col("ts")))
    visits.write.csv(path, escape='"')
    return tables.read_visits(spark, path).select(F.from_json("data", tables.VISIT).alias("v")).select("v.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items()}
