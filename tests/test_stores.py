import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.operators import ordering, streams
from tidelog.operators.archive import ArchiveView, foreach_event
from tidelog.operators.kv import DuplicateKeyError, SortedTable
from tidelog.sources import codec, exchange, files, stream_store, tables
from tidelog.sources.archive_store import Archive, ArchiveWriter
from tidelog.sources.errors import FormatError, ImmutableError
from tidelog.sources.stream_store import StreamLog
from tidelog.streaming import linker

EVENT = "space string, grouping string, ts long, seq long, data string, indexes map<string,string>"


def harbour(n=60, seed=4, nulls=False):
    """Port calls: many ties, several groupings; with ``nulls`` also missing groupings, times and index values."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        berth = rng.choice(["north", "south", ""] + ([None] if nulls else []))
        ts = None if nulls and rng.random() < 0.2 else rng.randrange(-3, 9)
        flag = None if nulls and rng.random() < 0.2 else rng.choice(["no", "se", "dk"])
        rows.append((rng.choice(["Bergen", "Ålesund", "Bodø"]), berth, ts, k + 1, f"call {k}", None if nulls and rng.random() < 0.1 else {"flag": flag, "any": ""}))
    return rows


def model(rows, space, grouping=None, key=None):
    """Payloads in scan order by plain sorting: newest first, no time last, ties as inserted."""
    picked = [r for r in rows if r[0] == space and (key is None and r[1] == grouping or key and any(v is not None and f"{n}:{v}" == key for n, v in (r[5] or {}).items()))]
    return [r[4] for r in sorted(picked, key=lambda r: (r[2] is None, -(r[2] or 0), r[3]))]


def data(df):
    return [r["data"] for r in df.collect()]


def store(spark, path, rows, **how):
    w = ArchiveWriter(spark, path, **how)
    w.add(spark.createDataFrame(rows, EVENT))
    w.write()
    return Archive.open(spark, path)


@pytest.mark.parametrize("nulls", [False, True])
def test_archive_scans(spark, tmp_path, nulls):
    rows = harbour(nulls=nulls)
    a = store(spark, str(tmp_path / "a"), rows, file_rows=7)
    assert [r["space"] for r in a.spaces().collect()] == sorted({r[0] for r in rows}, key=str.encode)
    for space in ("Bergen", "Bodø", "nowhere"):
        s = a.space(space)
        assert {r["grouping"] for r in s.groupings().collect()} == {r[1] for r in rows if r[0] == space}
        for grouping in ("north", "", "west", *([None] if nulls else [])):
            assert data(s.scan(grouping)) == model(rows, space, grouping)
        for key in ("flag:no", "any:", "flag:xx"):
            name, value = key.split(":")
            want = model(rows, space, key=key)
            assert data(s.scan_index(name, value)) == want
            assert data(s.scan_index(name, value, limit=3)) == want[:3]
            assert data(s.scan_index(name, value, ascending=True)) == want[::-1]


def test_early_stop(spark, tmp_path):
    rows = harbour()
    s = store(spark, str(tmp_path / "a"), rows).space("Bergen")
    want = model(rows, "Bergen", "north")
    assert data(s.scan_while("north", F.col("data") == want[2])) == want[:3]
    assert data(s.scan_while("north", F.col("data") == "no such call")) == want
    seen = []
    foreach_event(s.scan("north"), lambda r: seen.append(r["data"]) or len(seen) < 2)
    assert seen == want[:2]


def test_flush_and_immutability(spark, tmp_path):
    path, rows = str(tmp_path / "a"), harbour()
    df = spark.createDataFrame(rows, EVENT)
    w = ArchiveWriter(spark, path)
    w.add(df)
    w.flush("Bergen")
    w.flush("nowhere")
    with pytest.raises(ImmutableError, match="Cannot add to space"):
        w.add(df)
    w.add(spark.createDataFrame([("Oslo", "", 1, 99, "late", {})], EVENT))
    with pytest.raises(FormatError):
        Archive.open(spark, path)
    w.write()
    with pytest.raises(ImmutableError, match="Cannot add to database"):
        w.add(df)
    with pytest.raises(ImmutableError):
        w.write()
    with pytest.raises(FileExistsError, match="PATH_ALREADY_EXISTS"):
        ArchiveWriter(spark, path)
    a = Archive.open(spark, path)
    for space in ("Bergen", "Bodø"):
        assert data(a.space(space).scan_index("any", "")) == model(rows, space, key="any:")
    assert data(a.space("Oslo").scan("")) == ["late"] and a.events.count() == len(rows) + 1
    a.close()
    with pytest.raises(ValueError, match="closed"):
        a.space("Oslo")
    for k, bad in enumerate([("", "g", 1, 1, "x", {}), (None, "g", 1, 1, "x", {}), ("a", "g", 1, 1, "", {}), ("a", "g", 1, 1, None, {})]):
        v = ArchiveWriter(spark, str(tmp_path / f"bad{k}"))
        v.add(spark.createDataFrame([bad], EVENT))
        with pytest.raises(Exception, match="needs"):
            v.write()
    empty = ArchiveWriter(spark, str(tmp_path / "empty"))
    empty.write()
    assert Archive.open(spark, str(tmp_path / "empty")).spaces().count() == 0


def test_layout_follows_the_rows(spark, tmp_path):
    hot = [("Bergen", "", k, k + 1, "x", {"any": ""}) for k in range(200)]
    a = store(spark, str(tmp_path / "a"), hot + harbour(10), file_rows=20)
    assert len(a.space("Bergen").events.inputFiles()) > 5
    plan = a.space("Bergen").scan_index("any", "", limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(index_key,any:)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    counts = {k: 10**6 for k in range(4096)}
    assert len(files.spread_of(counts, 4096)) == 4096


def test_positions_and_chains_against_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-9, 9)]), rng.choice([None, *range(1, 400)]), k, k) for k in range(300)]
    df = spark.createDataFrame(rows, "space string, ts long, seq long, block long, _side_0 long")
    for width in (1, 7, 1 << 16):
        for ascending in (False, True):
            got = defaultdict(dict)
            found = ordering.scan_positions(df, ["space"], ascending, width)
            assert found.columns == [*df.columns, "pos"]
            for r in found.collect():
                got[r["space"]][r["pos"]] = (r["ts"], r["seq"])
            for s in ("a", "b", None):
                order = sorted((r[1:3] for r in rows if r[0] == s), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or 0), reverse=ascending)
                assert [got[s][k + 1] for k in range(len(order))] == order and len(got[s]) == len(order)
        found = ordering.previous(df, ["space"], width=width)
        for s in ("a", "b", None):
            own = sorted(r[2] for r in rows if r[0] == s and r[2] is not None)
            want = sorted(zip(own, [0, *own[:-1]], strict=True)) + [(None, 0)] * sum(r[0] == s and r[2] is None for r in rows)
            assert sorted(((r["seq"], r["prev"]) for r in found.where(F.col("space").eqNullSafe(F.lit(s))).collect()), key=repr) == sorted(want, key=repr)


def test_take_while_with_nulls(spark):
    rows = [(None, 3, 1, "x"), (None, None, 2, "stop"), (None, None, 3, "y"), ("a", 5, None, "p"), ("a", 5, 4, "stop"), ("a", 4, 5, "q"), ("b", None, None, None)]
    df = spark.createDataFrame(rows, "grouping string, ts long, seq long, data string")
    got = {(r["grouping"], r["pos"]): r["data"] for r in ordering.take_while(df, ["grouping"], F.col("data") == "stop").collect()}
    assert got == {(None, 1): "x", (None, 2): "stop", ("a", 1): "p", ("a", 2): "stop", ("b", 1): None}
    assert ordering.take_while(df.limit(0), ["grouping"], F.lit(True)).count() == 0
    cut = ordering.until_empty(df.withColumn("data", F.when(F.col("data") == "stop", "").otherwise(F.col("data"))), ["grouping"])
    assert sorted(map(repr, data(cut))) == ["'p'", "'x'", "None"]


def log_rows(spark, rows):
    return spark.createDataFrame([(k + 1, d, i) for k, (d, i) in enumerate(rows)], "seq long, data string, indexes map<string,string>")


def tides(n=23, seed=8):
    rng = random.Random(seed)
    return [(f"level {k}", {name: rng.choice("xyz") for name in rng.sample(["gauge", "moon", "a:b"], rng.randrange(3))}) for k in range(n)]


def chain(rows, name, value):
    return [d for d, i in rows if i.get(name) == value][::-1]


def test_stream_open_reopened_and_sealed(spark, tmp_path):
    path, rows = str(tmp_path / "s"), tides()
    log = StreamLog.create(spark, path, file_rows=5)
    assert (log.offset, log.length, log.closed, data(log.iterate()), log.first("gauge", "x")) == (0, 0, False, [], 0)
    log.append(log_rows(spark, rows[:9]))
    StreamLog.open(spark, path).append(log_rows(spark, rows[9:]))
    for handle in ("open", "sealed"):
        s = StreamLog.open(spark, path)
        for name in ("gauge", "moon", "a:b", "none"):
            for value in "xy":
                want = chain(rows, name, value)
                assert data(s.scan_index(name, value)) == want and data(s.scan_index(name, value, limit=2)) == want[:2]
                assert s.first(name, value) == max((k + 1 for k, (_, i) in enumerate(rows) if i.get(name) == value), default=0)
        assert data(s.iterate(limit=2)) == ["level 0", "level 1"] and data(s.iterate(22)) == ["level 21", "level 22"] and data(s.iterate(24)) == []
        assert s.offset == s.length == 23
        if handle == "open":
            s.seal()
            s.close()
    with pytest.raises(ImmutableError, match="sealed"):
        s.append(log_rows(spark, rows))
    with pytest.raises(FileExistsError):
        StreamLog.create(spark, path)
    with pytest.raises(FormatError):
        StreamLog.open(spark, str(tmp_path / "none"))


def test_cursors_walk_the_chain(spark, tmp_path):
    rows = tides()
    log = StreamLog.create(spark, str(tmp_path / "s"))
    log.append(log_rows(spark, rows))
    at, seen = 0, []
    while True:
        row = log.scan_index("moon", "x", at, 1).first()
        seen.append(row["data"])
        at = row["prev"]
        if not at:
            break
    assert seen == chain(rows, "moon", "x")
    at, seen = 0, []
    for _ in range(4):
        got = streams.iterate(log.events(), at, 10)
        seen += data(got)
        at = streams.next_cursor(got, at).first()["cursor"]
    assert (seen, at) == ([d for d, _ in rows], 24)


def test_failed_and_torn_appends_leave_no_trace(spark, tmp_path):
    log, rows = StreamLog.create(spark, str(tmp_path / "s")), tides(6)
    log.append(log_rows(spark, rows[:3]))
    with pytest.raises(ValueError):
        log.append(log_rows(spark, rows[3:]).withColumn("seq", F.col("seq") + 5))
    with pytest.raises(Exception, match="seq"):
        log.append(log_rows(spark, rows[3:]).withColumn("seq", F.lit(None).cast("long")))
    log_rows(spark, rows).write.parquet(f"{log.path}/append-1-torn/events")
    log.append(log_rows(spark, rows[3:]))
    assert data(log.iterate()) == [d for d, _ in rows]
    assert log.recover() == ["append-1-torn"] and log.recover() == []
    assert data(log.iterate()) == [d for d, _ in rows]
    assert log.append(log_rows(spark, [])) == 0 and log.length == 6


def test_of_two_appends_at_a_time_one_is_refused(spark, tmp_path):
    log, rows = StreamLog.create(spark, str(tmp_path / "s")), tides(4)
    version, state = log._latest()
    log.append(log_rows(spark, rows))
    late = StreamLog.open(spark, log.path)
    late._latest = lambda: (version, state)
    with pytest.raises(files.CommitConflict):
        late.append(log_rows(spark, rows))
    assert StreamLog.open(spark, log.path).length == 4 and log.recover() == []


def test_append_in_the_order_of_columns_and_folded_tails(spark, tmp_path):
    log, rows = StreamLog.create(spark, str(tmp_path / "s")), tides(30)
    rng = random.Random(1)
    for at in range(0, 30, 3):
        part = [(k, d, i, "ignored") for k, (d, i) in enumerate(rows[at : at + 3])]
        rng.shuffle(part)
        log.append(spark.createDataFrame(part, "k long, data string, indexes map<string,string>, place string"), ["k"])
    assert data(log.iterate()) == [d for d, _ in rows] and len(log.state["tails"]) <= stream_store.FOLD
    for name in ("gauge", "moon", "a:b"):
        assert data(log.scan_index(name, "y")) == chain(rows, name, "y")
        assert log.first(name, "y") == max(k + 1 for k, (_, i) in enumerate(rows) if i.get(name) == "y")


def test_merge(spark, tmp_path):
    parts = [tides(5, seed=s) for s in (1, 2, 3)]
    for k, rows in enumerate(parts):
        StreamLog.create(spark, str(tmp_path / f"{k}")).append(log_rows(spark, [(f"{k} {d}", i) for d, i in rows]))
    StreamLog.open(spark, str(tmp_path / "1")).seal()
    m = stream_store.merge(spark, str(tmp_path / "all"), [str(tmp_path / f"{k}") for k in range(3)])
    whole = [(f"{k} {d}", i) for k, rows in enumerate(parts) for d, i in rows]
    assert data(m.iterate()) == [d for d, _ in whole] and m.closed
    assert data(m.scan_index("gauge", "x")) == chain(whole, "gauge", "x")


def test_stores_on_another_file_system(spark, tmp_path):
    """Paths of a mount table: only Spark's file systems open them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tide.link./m", f"file://{tmp_path}")
    rows = harbour(12)
    a = store(spark, "viewfs://tide/m/a", rows)
    assert data(a.space("Bergen").scan("north")) == model(rows, "Bergen", "north")
    log = StreamLog.create(spark, "viewfs://tide/m/s")
    log.append(log_rows(spark, tides(5)))
    assert data(StreamLog.open(spark, "viewfs://tide/m/s").iterate()) == [d for d, _ in tides(5)]


def test_sorted_table(spark, tmp_path):
    pairs = {b"reef": b"2", b"\xffz": b"9", b"Reef": b"1", b"ree": None, b"a\x00": b"3"}
    rows = spark.createDataFrame([(bytearray(k), v and bytearray(v), "other") for k, v in pairs.items()], "key binary, value binary, block string")
    SortedTable.build(rows, str(tmp_path / "t"))
    t = SortedTable.open(spark, str(tmp_path / "t"))
    assert bytes(t.get(b"reef")) == b"2" and t.get(b"ree") is None and t.get(b"zz") is None
    for low in (None, b"", b"ree", b"reeg", b"\xff"):
        assert [bytes(r["key"]) for r in t.find(low).collect()] == sorted(k for k in pairs if k >= (low or b""))
    with pytest.raises(DuplicateKeyError):
        SortedTable.build(rows.union(rows), str(tmp_path / "u"))
    assert not files.exists(spark, str(tmp_path / "u"))
    with pytest.raises(FileExistsError):
        SortedTable.build(rows, str(tmp_path / "t"))
    with pytest.raises(Exception, match="null"):
        SortedTable.build(spark.createDataFrame([(None, bytearray(b"v"))], "key binary, value binary"), str(tmp_path / "n"))
    with pytest.raises(FormatError):
        SortedTable.open(spark, str(tmp_path / "none"))


def test_keys(spark):
    df = spark.createDataFrame([(["a:b:c", "a:z", "n:"],)], "k array<string>")
    assert df.select(keys.indexes_of(F.col("k")).alias("m")).first()["m"] == {"a": "z", "n": ""}
    m = spark.createDataFrame([({"a": "b", "n": None},), (None,)], "i map<string,string>")
    assert [r[0] for r in m.select(keys.index_keys(F.col("i"))).collect()] == [["a:b"], None]
    assert ArchiveView(spark.createDataFrame(harbour(5, nulls=True), EVENT)).postings.where("index_key is null").count() == 0


def test_visits(spark, tmp_path):
    (tmp_path / "v.csv").write_text('moor,q7,"Vardø, ""east""",s1,5\nleave,,,s2,\n')
    got = tables.read_visits(spark, str(tmp_path / "v.csv"))
    assert [r["data"] for r in got.collect()] == ['{"type":"moor","host":"q7","city":"Vardø, \\"east\\"","visitor":"s1","timestamp":5}', '{"type":"leave","visitor":"s2"}']
    assert tables.visits_as_events(got.withColumn("seq", F.col("timestamp"))).columns == ["space", "grouping", "ts", "seq", "data", "indexes"]


def test_linking_survives_a_restart_and_folds(spark, sf_dir, tmp_path):
    src, target, mark, marked = (str(tmp_path / x) for x in ("src", "out", "mark", "marked"))
    log = tables.event_log(spark, sf_dir)
    before, linker.FOLD = linker.FOLD, 2
    try:
        for a, b in ((0, 150), (150, 400), (400, 700), (700, 900), (900, 2000)):
            log.where(f"seq > {a} and seq <= {b}").repartition(1).write.mode("append").parquet(src)
            linker.link_batches(linker.read_log(spark, src, log.schema), target, mark).awaitTermination()  # a new query each time
            linker.tails_query(linker.read_log(spark, src, log.schema), target + "-tails", marked).awaitTermination()
        want = streams.links(log).select("seq", "index_key", "prev")
        got = linker.links(spark, target).select("seq", "index_key", "prev")
        assert got.count() == want.count() and want.exceptAll(got).isEmpty()
        for place in (target, target + "-tails"):
            assert linker.tails(spark, place).exceptAll(streams.tails(log)).isEmpty() and linker.tails(spark, place).count() == streams.tails(log).count()
        assert "batch=0" not in files.names(spark, f"{target}/tails")
    finally:
        linker.FOLD = before


def test_blocks_seek_and_peek():
    raw = b"salt water " * 900 + bytes(range(256))
    w = codec.BlockWriter(100)
    for at in range(0, len(raw), 33):
        w.write(raw[at : at + 33])
        assert w.buffered <= 100
    w.flush()
    assert w.count == -(-len(raw) // 100) and codec.read_blocks(bytes(w.out), 100) == raw == codec.read_blocks(codec.blocks(raw, 70_000), 70_000)
    r = codec.BlockReader(bytes(w.out), 100)
    assert (r.peek(3), r.read(4), r.read_byte()) == (b"sal", b"salt", 32)
    r.seek(0)
    second = r.read(100) and r.next
    r.seek(second)
    assert r.read(120) == raw[100:220]
    with pytest.raises(ValueError):
        r.seek(0, 1)
    with pytest.raises(FormatError):
        codec.read_blocks(bytes(w.out[:-1]), 100)


def test_table_bytes():
    rng, w, want = random.Random(5), codec.TableWriter(), {}
    for k in sorted({rng.randbytes(rng.randrange(1, 6)) for _ in range(2000)}):
        want[k] = rng.randbytes(rng.randrange(30))
        w.set(k, want[k])
    with pytest.raises(ValueError):
        w.set(k, b"")
    raw = w.close()
    t = codec.TableReader(raw)
    assert dict(t.find()) == want and list(t.find(b"\x80")) == sorted((k, v) for k, v in want.items() if k >= b"\x80")
    assert t.get(k) == want[k] and t.get(k + b"x") is None
    assert list(codec.TableReader(codec.TableWriter().close()).find()) == []
    with pytest.raises(FormatError):
        codec.TableReader(raw[:-1])
    with pytest.raises(FormatError):
        list(codec.TableReader(raw[:50] + b"!" + raw[51:]).find())


def test_archive_files(spark, tmp_path):
    rows = harbour(80) + [("Bergen", "big", k, 100 + k, "m" * n, {"any": ""}) for k, n in enumerate((4090, 4090, 1, 4096, 20_000))]
    df = spark.createDataFrame(rows, EVENT).withColumn("path", F.col("space"))
    for r in exchange.archive_files(df, "path").collect():
        (tmp_path / r["path"]).write_bytes(bytes(r["content"]))
    found = exchange.read_archives(exchange.binary_files(spark, str(tmp_path))).orderBy("pos").collect()
    assert len(found) == len(rows)
    for space in ("Bergen", "Ålesund"):
        for grouping in ("north", "", "big"):
            own = [r for r in found if (r["space"], r["grouping"]) == (space, grouping)]
            assert [bytes(r["data"]).decode() for r in own] == model(rows, space, grouping)
            keys_of = {r[4]: sorted(f"{n}:{v}" for n, v in r[5].items()) for r in rows}
            assert all(sorted(r["keys"]) == keys_of[bytes(r["data"]).decode()] for r in own)
    with pytest.raises(Exception, match="index"):
        exchange.read_archives(spark.createDataFrame([("p", bytearray(b"not an archive at all"))], "path string, content binary")).collect()
    assert exchange.read_archives(spark.createDataFrame([("p", None)], "path string, content binary")).count() == 0


def test_archive_parts_are_the_plain_files(spark, tmp_path):
    """Files of several spaces in parts are byte for byte what the plain functions make of all rows, and are read as they read them."""
    rng = random.Random(8)
    rows = harbour(400) + [("Bergen", None, rng.choice([5, rng.randrange(-9, 99)]), 1000 + k, f"{rng.random()} " * rng.choice([1, 9]), {"any": "", "n": str(k % 7), "of": f"é{k}"}) for k in range(9000)]
    rows += [("Bodø", "bare", 3, 20_000, "no index", None), ("Bodø", "bare", 3, 20_001, "w" * 300_000, {"any": ""}), ("Moss", "x", -1, None, "last", {"any": ""}), ("Moss", "x", -1, 7, "first", {"any": ""})]
    df = spark.createDataFrame(rows, EVENT).withColumn("path", F.when(F.col("space") == "Moss", "b").otherwise("a"))
    stored = str(tmp_path / "parts")
    exchange.archive_parts(df.repartition(7), "path").write.parquet(stored)
    parts = spark.read.parquet(stored)
    plain = {}
    for path, of in (("a", lambda s: s != "Moss"), ("b", lambda s: s == "Moss")):
        spaces = defaultdict(list)
        for space, grouping, ts, _, text, indexes in sorted((r for r in rows if of(r[0])), key=lambda r: (r[3] is None, r[3])):
            spaces[space].append((grouping or "", ts, text.encode(), indexes or {}))
        plain[path] = codec.archive_bytes(spaces)
        own = [bytes(r["content"]) for r in parts.where(F.col("path") == path).orderBy("part").collect()]
        assert b"".join(own) == plain[path] and all(len(c) == exchange.PART for c in own[:-1])
    assert len(plain["a"]) > 5 * exchange.PART
    assert {r["path"]: bytes(r["content"]) for r in exchange.archive_files(df, "path").collect()} == plain
    found = [(r["path"], r["space"], r["grouping"], r["pos"], r["ts"], bytes(r["data"]), r["keys"]) for r in exchange.read_archive_parts(parts).collect()]
    assert sorted(found) == sorted((path, *event) for path, raw in plain.items() for event in codec.read_archive(raw))
    for part in (0, 2):
        with pytest.raises(Exception, match="missing|fit"):
            exchange.read_archive_parts(parts.where(F.col("part") != part)).collect()
    with pytest.raises(Exception, match="needs data"):
        exchange.archive_parts(df.withColumn("data", F.lit("")), "path").collect()
    assert exchange.read_archive_parts(exchange.archive_parts(df.limit(0), "path")).count() == 0


def test_archive_sections_are_read_piece_by_piece():
    """Events come before the rest of their section is read, and of a file only the parts with tables are held."""
    rng = random.Random(9)
    raw = codec.archive_bytes({"Bergen": [("", k, rng.randbytes(50), {"n": str(k % 9)}) for k in range(5000)]})
    size, seen = 4096, []

    def part(k):
        seen.append(k)
        return k * size, raw[k * size : (k + 1) * size]

    last = len(raw) // size
    sections = {key: (base, at, n) for _, key, base, at, n in codec.archive_sections(part(k) for k in range(last, -1, -1))}
    assert seen == list(range(last, -1, -1)) and len(sections) == 10
    base, at, n = sections[b"g"]
    pulled = []
    pieces = (pulled.append(k) or raw[k : min(k + 100, base + at + n)] for k in range(base + at, base + at + n, 100))
    events = codec.section_events(pieces, at)
    assert next(events)[2:4] == (1, 4999) and len(pulled) < 90
    assert [e[2] for e in events] == list(range(2, 5001))
    with pytest.raises(FormatError):
        list(codec.section_events([raw[base + at : base + at + n - 1]], at))


def test_log_files(spark):
    rows = tides(9)
    log = log_rows(spark, rows).withColumn("stream", F.lit("s"))
    for seal in (True, False):
        content = bytes(exchange.log_files(log, seal=seal).first()["content"])
        assert (codec.log_tails(content) is None) == (not seal)
        one = spark.createDataFrame([("s", bytearray(content))], "path string, content binary")
        got = exchange.read_logs(one).orderBy("seq").collect()
        assert [bytes(r["data"]).decode() for r in got] == [d for d, _ in rows]
        at, chained = codec.log_tails(content)["moon:x"] if seal else 0, []
        while at:
            r = next(r for r in got if r["offset"] == at)
            chained.append(bytes(r["data"]).decode())
            at = r["prev"]["moon:x"]
        assert not seal or chained == chain(rows, "moon", "x")
    torn = one.withColumn("content", F.lit(bytearray(content + b"torn!")))
    assert exchange.read_logs(torn, "DROP_TAIL").count() == 9
    with pytest.raises(Exception, match="shorter"):
        exchange.read_logs(torn).collect()
    with pytest.raises(Exception, match="header"):
        exchange.read_logs(one, header=b"other").collect()
    nothing = spark.createDataFrame([(None, None, None)], "d binary, i map<string,string>, t map<string,long>")
    assert bytes(nothing.select(exchange.serialized(F.col("d"), F.col("i"), F.col("t"))).first()[0]) == b"\x02\0\0\0\0\0"


def test_files_are_made_from_streams_of_rows(spark):
    """No group of rows is handed to Python as a whole; several logs in one task stay apart."""
    rows = [(f"s{k % 3}", None if k == 5 else k, f"tide {k}", {"moon": str(k % 2)}) for k in range(60)]
    log = spark.createDataFrame(rows, "stream string, seq long, data string, indexes map<string,string>").coalesce(1)
    files_ = exchange.log_files(log)
    for made in (files_, exchange.archive_parts(log.withColumn("space", F.lit("a")).withColumn("grouping", F.lit("")).withColumn("ts", F.lit(1)), "stream")):
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    for r in files_.collect():
        own = sorted((x for x in rows if x[0] == r["path"]), key=lambda x: (x[1] is None, x[1]))
        assert bytes(r["content"]) == codec.log_bytes((d.encode(), i) for _, _, d, i in own)
    assert files_.count() == 3


def test_record_sizes_at_the_borders_of_varints(spark):
    """A record of one entry is as long as its older offset's varint: 4 bytes from 2**21 on."""
    borders = {2**7 - 1: 1, 2**7: 2, 2**14 - 1: 2, 2**14: 3, 2**21 - 1: 3, 2**21: 4, 2**28 - 1: 4, 2**28: 5}
    rows = spark.createDataFrame([(at, "tide", {"type": "ebb"}, {"type:ebb": at}) for at in borders], "at long, d string, i map<string,string>, t map<string,long>")
    for r in rows.select("at", exchange.serialized(F.col("d"), F.col("i"), F.col("t")).alias("r")).collect():
        assert len(r["r"]) == 4 + 1 + 4 + 1 + 1 + 8 + borders[r["at"]]
        assert codec.deserialize(bytes(r["r"])) == (b"tide", {"type:ebb": r["at"]})
