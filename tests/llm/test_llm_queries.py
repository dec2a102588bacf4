"""The registered queries of the corpus operators; those with SQL against it."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import table
from jobloom.llm.queries import ORACLES, QUERIES
from jobloom.plans.standins import TABLES

SF = "/root/testdata/sf0.001"


def test_registry():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.queries()) >= {*QUERIES, "pipeline"} and set(entry.oracle_sql()) >= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())
