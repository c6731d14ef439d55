import os

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if not isinstance(v, bool | str) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(entry.audit_queries.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    assert isinstance(df, DataFrame)
    names = sorted(df.columns)
    rel = oracle.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    at = [rel.columns.index(c) for c in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert entry.entry(spark).count() > 0
