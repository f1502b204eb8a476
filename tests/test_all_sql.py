"""Every query that has SQL gives its rows, at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__
from lorewell.plans import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = tables.sql(oracle.SQL[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    rows = [tuple(plain(r[i]) for i in order) for r in want.fetchall()]
    assert sorted(map(str, (tuple(plain(r[c]) for c in cols) for r in df.collect()))) == sorted(map(str, rows))
