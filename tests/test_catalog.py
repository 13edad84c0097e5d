"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lamina import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return frame.astype(object).where(frame.notna(), None).sort_values(list(frame.columns)).values.tolist()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
