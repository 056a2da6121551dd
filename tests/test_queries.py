"""Every registered query of the core against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veridelta.plans import queries as core

DIR = "/root/testdata/sf0.001"


def norm(df):
    df = df[sorted(df.columns)].astype(object)
    null = lambda v: str(v) in ("None", "nan", "<NA>", "NaT")
    return sorted(str([None if null(v) else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, DIR).toPandas()
    if name in core.SQL:
        want = duck.sql(core.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
