"""Every registered query with SQL, against DuckDB on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cowlens.plans import catalogue, images  # noqa: E402

QUERIES, ORACLES = {**catalogue.QUERIES, **images.QUERIES}, {**catalogue.ORACLES, **images.ORACLES}

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame, cols):
    return sorted(tuple(str(x) for x in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    a = QUERIES[name](spark, SF).toPandas()
    b = duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert rows(a, cols) == rows(b, cols)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["q_layered_read"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan
    pushed = catalogue.QUERIES["q_resize_guard"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in pushed
