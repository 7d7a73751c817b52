"""Every registered query of the library against its SQL in DuckDB; those without SQL must give rows."""

import os

import duckdb
import pytest

from gridloom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def sf():
    """The scale at which the thresholds of the queries select something."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for n in os.listdir(sf):
        c.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{n}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind == "f":
            df[c] = (df[c] + 0.0).round(9)
    return df.astype(str).sort_values(cols).reset_index(drop=True)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) or name == "morph_opening"
    if name in SQL:
        want = db.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))
