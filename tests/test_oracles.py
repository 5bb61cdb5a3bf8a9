"""Every query with SQL equals DuckDB's result; the others give rows."""

import duckdb
import pytest

from boxloom import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return df.astype(str).sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, tiny, duck, name):
    got, want = rows(queries.queries()[name](spark, tiny).toPandas()), rows(duck.sql(oracle.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_has_rows(spark, tiny, name):
    assert queries.queries()[name](spark, tiny).count() > 0
