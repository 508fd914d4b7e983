"""Queries with SQL, side by side with a checking engine on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def engine():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(df, columns):
    cell = lambda v: "∅" if v is None or v is pd.NA or v != v else str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("query", sorted(SQL))
def test_same_rows(spark, engine, query):
    ours, theirs = __spark_entry__.queries()[query](spark, FOLDER).toPandas(), engine.execute(SQL[query]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours, sorted(ours.columns)) == plain(theirs, sorted(ours.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
