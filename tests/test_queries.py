"""Every registered query against its SQL, and the entry point."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from plumbline import catalog, feeds, tools  # noqa: F401

@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df, columns):
    """Rows as sorted tuples of text; nulls and whole floats made alike."""

    def text(v):
        if pd.isna(v):
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) > 35


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
