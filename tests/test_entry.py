"""Each query with SQL gives the SQL's rows on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lectern import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = sorted(registry.ORACLES)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([round(float(x), 6) if isinstance(x, float) else x if isinstance(x, (int, str)) else str(x) for x in r]) for r in df.values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 10
