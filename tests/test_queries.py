"""The catalogue against DuckDB, and the driver's entry."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from ticketloom.plans import index_queries, more_queries, queries

ORACLE_SQL, QUERIES = queries.ORACLE_SQL | more_queries.ORACLE_SQL | index_queries.ORACLE_SQL, queries.QUERIES | more_queries.QUERIES | index_queries.QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("-" if v is None else f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) == 77
