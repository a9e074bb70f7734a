"""Every registered query of the core against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tallyward import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return float(v) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    if name not in catalogue.ORACLE:
        assert got
        return
    rel = duck.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
