from datetime import date

import pytest

from tidelake.dq.runner import Runner, exit_code, report, results_frame
from tidelake.dq.suite import SuiteError, load_suite, parse_suite

PREV, DAY = date(2017, 3, 1), date(2017, 3, 2)


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([("a", "p1", 1.0, "SP", PREV), ("b", "p1", 2.0, "RJ", PREV), ("c", "p1", 5.0, "SP", DAY), ("c", "p1", 5.0, "SP", DAY), ("d", None, 5.0, "XX", DAY), ("e", "p9", -1.0, None, DAY)], "id string, parent string, price double, state string, _batch_date date")
    return {"silver.items": items, "silver.parents": spark.createDataFrame([("p1", PREV), ("p9", DAY)], "id string, _batch_date date")}


def run(tables, checks, previous=lambda *_: None, **table):
    suite = parse_suite("silver", {"tables": {"silver.items": {"key": ["id"], "checks": checks, **table}}})
    return {r.check: r for r in Runner(suite, DAY, tables.get, previous).run()}


def test_dirty_batch(tables):
    got = run(tables, [
        {"type": "not_null", "columns": ["parent"]}, {"type": "unique", "columns": ["id"]}, {"type": "accepted_values", "column": "state", "values": ["SP", "RJ"]},
        {"type": "accepted_values", "name": "state_needed", "column": "state", "values": ["SP", "RJ"], "allow_null": False}, {"type": "range", "column": "price", "min": 0, "max": 5, "severity": "warn"},
        {"type": "relationship", "column": "parent", "ref": "silver.parents.id", "ref_where": "id != 'p9'"}, {"type": "expression", "expr": "price > 0", "name": "positive"}, {"type": "expression", "expr": "state IS NOT NULL AND state < 'S'", "name": "null_fails", "where": "id = 'e'"},
        {"type": "row_count_vs_previous"}, {"type": "not_null", "name": "all_rows", "columns": ["state"], "scope": "table"}, {"type": "not_null", "name": "newest", "columns": ["state"], "scope": "latest"},
    ])
    failed = {k: r.failed_rows for k, r in got.items()}
    assert failed == {"not_null_parent": 1, "unique_id": 2, "accepted_values_state": 1, "state_needed": 2, "range_price": 1, "relationship_parent": 1, "positive": 1, "null_fails": 1, "row_count_vs_previous": 0, "all_rows": 1, "newest": 1}
    assert got["range_price"].status == "warn" and not got["range_price"].blocking and got["unique_id"].blocking
    assert got["row_count_vs_previous"].observed == 4 and got["unique_id"].sample == [{"id": "c", "count": 2}]
    assert got["relationship_parent"].sample == [{"id": "e", "parent": "p9"}] and got["not_null_parent"].sample == [{"id": "d"}]
    assert exit_code(list(got.values())) == 1 and "blocking of 11" in report(list(got.values()))


def test_schema_and_missing_columns(tables):
    got = run(tables, [{"type": "schema", "columns": {"price": "int", "extra": "string"}}, {"type": "not_null", "columns": ["extra"], "severity": "warn"}, {"type": "expression", "name": "odd", "expr": "nothing = 1", "severity": "warn"}, {"type": "not_null", "name": "fine", "columns": ["id"]}, {"type": "schema", "name": "strict", "columns": {"id": "string"}, "allow_extra": False}])
    assert got["schema"].failed_rows == 2 and got["strict"].failed_rows == 4 and got["fine"].status == "pass"
    assert got["not_null_extra"].status == got["odd"].status == "error_running" and got["odd"].blocking


@pytest.mark.parametrize(("before", "status", "detail"), [(None, "pass", ""), (8, "pass", "0.50"), (100, "fail", "ratio 0.04"), (0, "pass", ""), (1, "fail", "ratio 4.00")])
def test_row_count_ratio(tables, before, status, detail):
    got = run(tables, [{"type": "row_count_vs_previous", "min_ratio": 0.5, "max_ratio": 2}], lambda *_: before)["row_count_vs_previous"]
    assert got.status == status and detail in got.detail


def test_tables_that_are_not_there(spark, tables):
    spec = {"tables": {"silver.no": {"optional": True, "checks": [{"type": "unique", "columns": ["x"]}]}, "silver.none": {"checks": [{"type": "unique", "columns": ["x"]}]}}}
    results = Runner(parse_suite("silver", spec), DAY, tables.get).run()
    assert [r.status for r in results] == ["skipped", "error_running"]
    assert results_frame(spark, "silver", DAY, results).count() == 2 and Runner(parse_suite("silver", spec), DAY, tables.get).run({"silver.no"})[0].status == "skipped"
    assert run(tables, [{"type": "not_null", "columns": ["id"]}], batch_column="nope")["not_null_id"].status == "error_running"
    assert run(tables, [{"type": "not_null", "columns": ["id"], "scope": "table"}], batch_column="nope")["not_null_id"].status == "pass"


@pytest.mark.parametrize(("check", "why"), [
    ({"type": "magic"}, "unknown check type"), ({"type": "not_null"}, "needs columns"), ({"type": "range", "column": "a"}, "min or max"), ({"type": "unique", "columns": ["a"], "colour": 1}, "unknown parameters"),
    ({"type": "unique", "columns": ["a"], "severity": "bad"}, "severity"), ({"type": "unique", "columns": ["a"], "scope": "era"}, "scope"), ({"type": "relationship", "column": "a", "ref": "b"}, "layer.table.column"),
])
def test_bad_suites(check, why):
    with pytest.raises(SuiteError, match=why):
        parse_suite("x", {"tables": {"x.t": {"checks": [check]}}})


def test_bad_suites_as_a_whole(tmp_path):
    same = {"type": "unique", "columns": ["a"]}
    with pytest.raises(SuiteError, match="more than one"):
        parse_suite("x", {"tables": {"x.t": {"checks": [same, same]}}})
    with pytest.raises(SuiteError, match="tables"):
        parse_suite("x", [])
    (tmp_path / "s.yaml").write_text("tables:\n  x.t:\n    key: [a]\n    checks:\n      - {type: unique, columns: [a]}\n")
    assert load_suite("x", tmp_path / "s.yaml").tables[0].checks[0].name == "unique_a"


@pytest.mark.parametrize(("layer", "checks"), [("bronze", 32), ("silver", 47), ("gold", 31)])
def test_shipped_suites(layer, checks):
    assert sum(len(t.checks) for t in load_suite(layer).tables) == checks
