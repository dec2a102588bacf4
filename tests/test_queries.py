"""Every registered query against its SQL on the check engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import table
from jobloom.plans.standins import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) - set(entry.LLM_QUERIES) == {"embed_jobs"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert len(got[0]) > 0
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["institution", "jobs"]
