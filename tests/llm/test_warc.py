import hashlib

import pytest

from tidelog.llm import warc

from .helpers import rows_of

SCHEMA = "page_id long, url string, html string, digest string, header string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "h") for r in rows], SCHEMA)


def brute(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body]
        last = max([p for p in same if p is not None], default=None)
        revisit = len(body) >= 1000 and last is not None and page != last
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/\r\nWARC-Type: x\x00\x01\x1f\x7f", "é" * 500), (5, None, "é" * 500), (5, "http://c/", "é" * 500), (3, "u", "é" * 500), (4, "u", "a" * 999), (6, "u", "a" * 999),
    (7, "u", None), (8, "u", ""), (None, "u", "b" * 1000), (None, "u", "b" * 1000), (None, "u", "é" * 500), (9, "u", "\r\n\r\n" * 100_000), (-10, "u", "\r\n\r\n" * 100_000),
]


def test_rows(spark):
    assert sorted(map(tuple, warc.archive(table(spark, ROWS)).collect()), key=repr) == brute(ROWS)
    assert warc.archive(table(spark, [])).count() == 0


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sorted(map(tuple, warc.archive(pages).collect()), key=repr) == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


@pytest.mark.parametrize("part", [1_000_000, 2])
def test_records_come_back(spark, tmp_path, part):
    path, ids = str(tmp_path / "w"), set()
    warc.write(table(spark, ROWS), path, part=part)
    assert warc.payloads(spark, path).count() == len({(h or "") for _, _, h in ROWS})
    got = rows_of(warc.records(spark, path))
    assert len(got) == len(ROWS)
    for page, record in ((r["page_id"], bytes(r["record"])) for r in got):
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        if b"WARC-Type: response" in head:
            assert rest[:length].decode() in [h or "" for p, _, h in ROWS if p == page]
        assert head.count(b"\r\nWARC-Type:") == 1 and not any(c in head.replace(b"\r\n", b"") for c in [*range(32), 127])
        ids.add(head.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0])
    assert len(ids) == len(ROWS)
    assert sorted(map(tuple, warc.read(spark, path, part).collect()), key=repr) == brute(ROWS)


def test_changed_or_missing_payload_is_noticed(spark, tmp_path):
    path, bad = str(tmp_path / "w"), str(tmp_path / "bad")
    warc.write(table(spark, ROWS), path)
    warc.headers(spark, path).write.parquet(f"{bad}/headers")
    p = warc.payloads(spark, path)
    for change in ("cast(concat(cast(payload as string), 'x') as binary)", "cast(reverse(cast(payload as string)) as binary)"):
        p.selectExpr("digest", f"{change} as payload").write.mode("overwrite").parquet(f"{bad}/payloads")
        with pytest.raises(Exception, match="does not match"):
            warc.read(spark, bad).collect()
    p.where("octet_length(payload) < 1000").write.mode("overwrite").parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read(spark, bad).collect()
