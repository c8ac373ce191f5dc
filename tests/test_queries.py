"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pulseline.plans import catalog


def rows(frame):
    out = []
    for values in frame[sorted(frame.columns)].itertuples(index=False):
        row = []
        for v in values:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                row.append("null")
            elif isinstance(v, str):
                row.append(v)
            elif isinstance(v, pd.Timestamp):
                row.append(v.isoformat())
            else:
                row.append(str(float(v)))
        out.append(tuple(row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
