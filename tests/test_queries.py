"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from tidelog.plans import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("events", "orders", "conversations", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = want.fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)
    assert rows
