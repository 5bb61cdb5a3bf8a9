"""Queries of this folder's operators that have SQL equal DuckDB's result."""

import duckdb
import pytest

from boxloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, small).select(*found.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))
