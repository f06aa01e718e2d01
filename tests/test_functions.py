from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidelake.functions import blank_to_null, calendar_columns, date_range, end_of_day, lenient_int, normalize_state, parse_first, salt, surrogate_key
from tidelake.functions.clean import ISO_TIME, LOCAL_TIME
from tidelake.session import Secret, settings_of


def values(spark, rows, kind, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_states(spark):
    raw = [" sp ", "Sp", "sp ", "São Paulo", "rio de janeiro", "MINAS GERAIS", "XX", None, "Paraná"]
    assert values(spark, raw, "string", normalize_state) == ["SP", "SP", "SP", "SP", "RJ", "MG", None, None, "PR"]


def test_blanks(spark):
    assert values(spark, [" ", "", None, " a "], "string", blank_to_null) == [None, None, None, "a"]


def test_two_formats(spark):
    found = values(spark, ["2017-03-01T14:22:05Z", "01/03/2017 14:22:05", "yesterday", None], "string", lambda c: parse_first(c, ISO_TIME, LOCAL_TIME))
    assert found == [datetime(2017, 3, 1, 14, 22, 5)] * 2 + [None, None]


@pytest.mark.parametrize(("raw", "want"), [("2", 2), ("two", None), ("2.5", 2), (".5", 0), ("1e2", None), ("2147483648", None), (" -7 ", -7), ("", None), ("+3.", 3), (None, None)])
def test_lenient_int(spark, raw, want):
    assert values(spark, [raw], "string", lenient_int) == [want]


def test_keys(spark):
    df = spark.range(1000)
    assert df.select(surrogate_key("a", "id")).distinct().count() == 1000
    assert df.where(surrogate_key("a", "id") == surrogate_key("b", "id")).count() == 0
    assert {r[0] for r in df.select(salt(4, "id")).distinct().collect()} == {0, 1, 2, 3}


def test_calendar(spark):
    df = date_range(spark, date(2017, 1, 1), date(2017, 12, 31)).select(*[c.alias(k) for k, c in calendar_columns("date").items()])
    assert df.count() == 365
    day = df.where("date_key = 20171124").first()
    assert (day.day_name, day.is_weekend, day.quarter, day.month_name) == ("Friday", False, 4, "November")
    assert spark.range(1).select(end_of_day(F.lit(date(2017, 1, 1)))).first()[0] == datetime(2017, 1, 1, 23, 59, 59)


def test_settings():
    base = {"db": {"port": 5432, "on": True, "names": ["a"], "key": "secret:store#k"}}
    out = settings_of(base, {"TIDELAKE__DB__PORT": "1", "TIDELAKE__DB__ON": "no", "TIDELAKE__DB__NAMES": "x, y", "TIDELAKE__NO__KEY": "1"}, secrets=lambda n: {"k": f"{n}!"})
    assert out["db"] == {"port": 1, "on": False, "names": ["x", "y"], "key": "store!"}
    assert repr(out["db"]["key"]) == "Secret(****)" and isinstance(out["db"]["key"], Secret)
    with pytest.raises(ValueError, match="secret"):
        settings_of({"k": "secret:broken"}, {})
    with pytest.raises(ValueError, match="boolean"):
        settings_of({"k": True}, {"TIDELAKE__K": "maybe"})
