import hashlib
import tarfile
import zlib

import pytest

from tidelog.llm import media

from .helpers import rows_of, table

ODD = [(1, None), (2, ""), (3, "é" * 288), (4, "é" * 288), (None, "x" * 577), (None, "x" * 577), (5, "abc\n" * 100_000), (6, "𝒳")]


def check(got, rows):
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got], key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        assert r["width"] == 576 and r["height"] * 576 == r["payload_bytes"] and r["length"] == r["media_bytes"]
        key = (r["media_bytes"], r["media_sha256"], r["feature"], r["shard"], r["offset"])
        assert by.setdefault(r["payload_sha256"], key) == key


def test_odd_texts(spark):
    check(rows_of(media.columns(table(spark, ODD).repartition(3))), ODD)
    assert media.columns(table(spark, [])).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(rows_of(media.columns(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_shards_are_tar_files(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 2000)
    index = media.store(table(spark, ODD))
    rows = rows_of(index)
    assert len(rows) == len({t or "" for _, t in ODD}) == len({r["digest"] for r in rows})
    for r in rows:
        with tarfile.open(r["shard"]) as tar:
            image = tar.extractfile(r["digest"] + ".png").read()
        with open(r["shard"], "rb") as f:
            f.seek(r["offset"])
            assert f.read(r["length"]) == image
        assert hashlib.sha256(media.decode(image)).hexdigest() == r["digest"]
        with pytest.raises(ValueError):
            media.decode(image[:45] + bytes([image[45] ^ 1]) + image[46:])


def test_features_against_plain_arithmetic(spark):
    """Mean, deviation, entropy and mean step of the padded bytes, counted one by one."""
    import math

    rows = [(1, None), (2, "abc"), (3, "é𝒳 \n" * 300), (4, "z" * 576)]
    for r in rows_of(media.columns(table(spark, rows))):
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = list(raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576)))
        n = len(payload)
        mean = sum(payload) / n
        counts = [payload.count(v) / n for v in set(payload)]
        want = {
            "mean": mean,
            "dev": math.sqrt(sum((x - mean) ** 2 for x in payload) / n),
            "entropy": -sum(p * math.log2(p) for p in counts),
            "step": sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (n - 1),
        }
        got = {k: float(v) for k, v in (part.split("=") for part in r["feature"].split(";"))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
