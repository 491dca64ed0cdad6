"""Queries of the operators against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from basaltiq.llm import queries as Q


@pytest.mark.parametrize("name", Q.ORACLE_SQL)
def test_same_rows(spark, small, name):
    got = Q.queries()[name](spark, small)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall(), key=str)
