"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from docspark.plans import catalog


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(v) for v in r] for r in df[cols].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())
    else:
        assert len(got.columns) > 0


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
