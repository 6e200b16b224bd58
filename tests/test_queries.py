"""Every core query against its SQL on the smallest tables, and the contract of the entry module."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioforge.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    out = df[cols].copy()
    for c in cols:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(6)
    return cols, sorted(map(tuple, out.astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_the_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
