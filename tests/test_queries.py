"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os
from collections import Counter
from datetime import datetime

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, name):
    df, r = entry.queries()[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    want = Counter(tuple(plain(x[r.columns.index(c)]) for c in df.columns) for x in r.fetchall())
    assert Counter(tuple(map(plain, x)) for x in df.collect()) == want


def test_whole_tables_are_read(spark, duck):
    days = duck.sql("SELECT count(DISTINCT d) FROM (SELECT o_orderdate::date AS d FROM orders UNION ALL SELECT l_shipdate::date FROM lineitem)").fetchall()[0][0]
    assert entry.queries()["affected_days"](spark, DATA).count() == days
    rows = duck.sql("SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM lineitem)").fetchall()[0][0]
    assert entry.queries()["multiset_difference"](spark, DATA).agg({"surplus": "sum"}).first()[0] == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans(spark):
    plan = lambda n: entry.queries()[n](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan("incremental_window")
    assert "WindowGroupLimit" in plan("latest_line_version") and "BroadcastHashJoin" in plan("order_lines_wide")
