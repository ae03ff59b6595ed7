"""Every registered query of the media engine against its SQL on the smallest tables."""

import datetime
import glob
import os

import pytest

import __spark_entry__ as entry
from reelspark import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def normal(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | datetime.datetime):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(([normal(v) for v in r] for r in cur.fetchall()), key=repr)
    assert sorted(([normal(r[c]) for c in cols] for r in df.collect()), key=repr) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["season", "resolution", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
