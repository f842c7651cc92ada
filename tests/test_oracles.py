"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.item() if isinstance(v, np.generic) else v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_oracle(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(n for n in set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql()) if not n.startswith(("op", "pipeline"))))
def test_rows_only(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
