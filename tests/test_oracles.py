"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from entivore.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["entity_id", "total_score", "attributes_present", "attributes_checked"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
