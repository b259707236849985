"""The registered queries run, and agree with their SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from mediashoal import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, np.floating)):
        return None if x != x else int(x) if x == int(x) else float(x)
    return x.item() if isinstance(x, np.generic) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in queries.ORACLE_SQL:
        rel = duck.sql(queries.ORACLE_SQL[name])
        assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "path", "sort_ts"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
