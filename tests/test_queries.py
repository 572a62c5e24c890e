"""Every registered query of the library runs; those with SQL agree with DuckDB on the smallest tables."""

import duckdb
import pytest

from echoweave.plans.all import QUERIES, SQL

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    def value(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(value(r[i]) for i in order)) for r in rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    out = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(out.columns)
    assert plain(df.collect(), df.columns) == plain(out.fetchall(), out.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
