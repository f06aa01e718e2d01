"""Quality checks as queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dq.runner import Runner, broken, results_frame
from ..dq.suite import Check, parse_suite
from .registry import query
from .roles import table


def _count(df: DataFrame, kind: str, **params) -> DataFrame:
    return df.agg(F.count_if(broken(Check(kind, kind, "error", "table", None, params))).alias("failed_rows"))


def _run(spark: SparkSession, tables: dict[str, DataFrame], check: dict, previous=lambda *_: None) -> DataFrame:
    """The failed rows of one check of the first table, by the runner."""
    suite = parse_suite("bronze", {"defaults": {"scope": "table"}, "tables": {next(iter(tables)): {"key": [], "checks": [check]}}})
    results = Runner(suite, date(2024, 1, 15), tables.get, previous).run()
    return results_frame(spark, "bronze", date(2024, 1, 15), results).select("failed_rows")


@query("SELECT count(*) FILTER (WHERE v IS NULL) AS failed_rows FROM (SELECT CASE WHEN event_id % 50 <> 0 THEN value END AS v FROM events)")
def dq_not_null(spark: SparkSession, d: str) -> DataFrame:
    return _count(table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 50 != 0, F.col("value"))), "not_null", columns=["event_id", "v"])


@query("SELECT coalesce(sum(n), 0)::bigint AS failed_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, {"bronze.test.lineitem": table(spark, d, "lineitem")}, {"type": "unique", "columns": ["l_orderkey", "l_linenumber"]})


@query("SELECT count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) AS failed_rows FROM events")
def dq_accepted_values(spark: SparkSession, d: str) -> DataFrame:
    return _count(table(spark, d, "events"), "accepted_values", column="event_type", values=["view", "click", "purchase"])


@query("SELECT count(*) FILTER (WHERE l_discount < 0.02 OR l_discount > 0.08) AS failed_rows FROM lineitem")
def dq_range(spark: SparkSession, d: str) -> DataFrame:
    return _count(table(spark, d, "lineitem"), "range", column="l_discount", min=0.02, max=0.08)


@query("SELECT count(*) FILTER (WHERE NOT coalesce(CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity * 1000 > l_extendedprice END, false)) AS failed_rows FROM lineitem")
def dq_expression(spark: SparkSession, d: str) -> DataFrame:
    return _count(table(spark, d, "lineitem"), "expression", expr="CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity * 1000 > l_extendedprice END")


@query("SELECT count(*) AS failed_rows FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def dq_relationship(spark: SparkSession, d: str) -> DataFrame:
    tables = {f"bronze.test.{n}": table(spark, d, n) for n in ("lineitem", "supplier")}
    return _run(spark, tables, {"type": "relationship", "column": "l_suppkey", "ref": "bronze.test.supplier.s_suppkey", "ref_where": "s_acctbal > 0"})


@query("SELECT sum((typeof <> expected)::int)::bigint AS failed_rows FROM (SELECT unnest([typeof(any_value(l_orderkey)), typeof(any_value(l_discount)), typeof(any_value(l_returnflag)), 'absent']) AS typeof, unnest(['BIGINT', 'BIGINT', 'VARCHAR', 'INTEGER']) AS expected FROM lineitem)")
def dq_schema(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, {"bronze.test.lineitem": table(spark, d, "lineitem")}, {"type": "schema", "columns": {"l_orderkey": "bigint", "l_discount": "bigint", "l_returnflag": "string", "l_absent": "int"}})


@query("SELECT (NOT count(*) / (SELECT count(*) FROM lineitem)::double BETWEEN 0.5 AND 2)::int::bigint AS failed_rows FROM orders")
def dq_row_count_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Orders against as many rows before as there are lines."""
    before = float(table(spark, d, "lineitem").count())
    return _run(spark, {"bronze.test.orders": table(spark, d, "orders")}, {"type": "row_count_vs_previous", "min_ratio": 0.5, "max_ratio": 2}, lambda *_: before)


SUITE = {
    "defaults": {"batch_column": "day", "scope": "batch"},
    "tables": {
        "bronze.test.events": {"key": ["event_id"], "checks": [
            {"type": "unique", "columns": ["event_id"], "scope": "table"},
            {"type": "not_null", "columns": ["event_id", "user_id"]},
            {"type": "accepted_values", "column": "event_type", "values": ["view", "click", "purchase", "signup", "error"]},
            {"type": "range", "column": "value", "min": 50, "severity": "warn"},
            {"type": "expression", "name": "errors_are_small", "expr": "value < 20", "where": "event_type = 'error'"},
            {"type": "relationship", "column": "user_id", "ref": "bronze.test.customer.c_custkey", "ref_where": "c_custkey > 5"},
            {"type": "schema", "columns": {"event_id": "bigint", "value": "float"}},
            {"type": "row_count_vs_previous", "min_ratio": 0.5, "max_ratio": 2},
        ]},
        "bronze.test.absent": {"optional": True, "key": [], "checks": [{"type": "not_null", "columns": ["x"]}]},
    },
}


@query("""WITH b AS (SELECT * FROM events WHERE ts::date = DATE '2024-01-15'), r AS (
SELECT 'unique_event_id' AS "check", coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM events WHERE ts::date <= DATE '2024-01-15' GROUP BY event_id HAVING count(*) > 1)), 0)::bigint AS failed_rows, 'fail' AS bad
UNION ALL SELECT 'not_null_event_id_user_id', count(*) FILTER (WHERE event_id IS NULL OR user_id IS NULL), 'fail' FROM b
UNION ALL SELECT 'accepted_values_event_type', count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')), 'fail' FROM b
UNION ALL SELECT 'range_value', count(*) FILTER (WHERE value < 50), 'warn' FROM b
UNION ALL SELECT 'errors_are_small', count(*) FILTER (WHERE event_type = 'error' AND NOT coalesce(value < 20, false)), 'fail' FROM b
UNION ALL SELECT 'relationship_user_id', count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 5)), 'fail' FROM b
UNION ALL SELECT 'schema', (typeof(any_value(value)) <> 'FLOAT')::int, 'fail' FROM b
UNION ALL SELECT 'row_count_vs_previous', (NOT count(*) / 100.0 BETWEEN 0.5 AND 2)::int, 'fail' FROM b)
SELECT "check", CASE WHEN failed_rows = 0 THEN 'pass' ELSE bad END AS status, failed_rows FROM r UNION ALL SELECT 'not_null_x', 'skipped', NULL""")
def dq_suite_report(spark: SparkSession, d: str) -> DataFrame:
    tables = {"bronze.test.events": table(spark, d, "events").withColumn("day", F.to_date("ts")), "bronze.test.customer": table(spark, d, "customer")}
    results = Runner(parse_suite("bronze", SUITE), date(2024, 1, 15), tables.get, lambda *_: 100.0).run()
    return results_frame(spark, "bronze", date(2024, 1, 15), results).select("check", "status", "failed_rows")
