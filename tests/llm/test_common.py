import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import common, secrets


def test_shared_values_need_no_installed_package(spark, tmp_path):
    net = secrets.Network(*[np.ones((2, 2)) for _ in range(7)], threshold=0.7)
    shared = common.Shared(spark, net)
    assert shared.load().threshold == 0.7
    path = tmp_path / "model"
    path.write_bytes(shared.box.value)
    code = "import pickle, sys; print(pickle.load(open(sys.argv[1], 'rb')).threshold); assert 'tidelog' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout == "0.7\n"


def test_hot_join(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else f"x{k}") for k in range(60)] + [(None, "lone"), (99, None)], "id long, key string")
    side = rows.where("key <> 'lone'").groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "upper(key) as up")
    for part in (7, 1_000):
        for how in ("inner", "left"):
            got = common.hot_join(rows, side, "key", "n", F.coalesce("id", F.lit(0)), part, how)
            want = rows.join(side.drop("n"), "key", how)
            assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_sieve_keeps_all_that_is_wanted_and_little_else(spark):
    ids = spark.range(20000).withColumn("hash", F.xxhash64("id"))
    wanted = ids.where("id % 10 = 0")
    for most, others in ((26, 0.07), (10, 1)):  # a full map passes everything
        kept = ids.where(common.sieve(wanted.select("hash"), most)(F.col("hash")))
        assert kept.where("id % 10 = 0").count() == 2000
        assert kept.count() - 2000 <= others * 18000
    assert ids.where(common.sieve(wanted.where("id < 0").select("hash"))(F.col("hash"))).count() == 0
