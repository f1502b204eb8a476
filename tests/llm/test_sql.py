"""The operators' queries give the rows of their SQL, at the smallest scale."""

import glob
import os

import pytest

from lorewell.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    c = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
