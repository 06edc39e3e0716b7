"""Every query with SQL beside it gives DuckDB's rows."""

import os

import duckdb
import pytest

from pointengine.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(mine.columns) == cols
    a, b = (x[cols].sort_values(cols, ignore_index=True).astype(object).values.tolist() for x in (mine, want))
    assert a == b
