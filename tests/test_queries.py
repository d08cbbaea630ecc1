"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from millrace.plans.registry import registry
from tests.conftest import SMALL

NAMES = sorted(registry())


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) else v


def rows(frame: pd.DataFrame) -> list:
    cols = sorted(frame.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    query, sql = registry()[name]
    got = query(spark, SMALL).toPandas()
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(registry()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
