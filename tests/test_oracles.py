"""Every query of the engine against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

from shardloom import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    expected = db.sql(catalog.ORACLES[name])
    assert columns == sorted(expected.columns)
    want = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
