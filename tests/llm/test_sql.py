import os

import duckdb
import pytest

from tracewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = db.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted([tuple(r[c] for c in names) for r in df.collect()], key=repr) == sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=repr)
