"""Every query that has SQL is held against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from spanisle import queries as base

QUERIES, ORACLE = base.queries(), base.oracle()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in base.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return repr(float(v))
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE:
        assert mine
        return
    found = duck.sql(ORACLE[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
