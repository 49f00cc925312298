"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from glyphlake.plans.oracle import ORACLE_SQL
from glyphlake.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(tuple("NULL" if x is None or x != x else str(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("part", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))
