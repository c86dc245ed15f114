"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelkite.queries import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or (not isinstance(value, list | np.ndarray) and pd.isna(value)):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, float | np.floating):
        return float(value) + 0.0
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else value


def rows(frame, columns):
    return sorted((tuple(map(cell, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_sql_is_for_queries():
    assert set(SQL) <= set(QUERIES)
