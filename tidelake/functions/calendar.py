"""Dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def date_range(spark: SparkSession, start: date, end: date, name: str = "date") -> DataFrame:
    """A row for each day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))).alias(name))


def calendar_columns(d: Column | str) -> dict[str, Column]:
    """The attributes of a day. Weeks are ISO weeks; the weekend is Saturday and Sunday."""
    d = F.col(d) if isinstance(d, str) else d
    return {
        "date_key": F.date_format(d, "yyyyMMdd").cast("int"), "date": d, "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"), "day": F.dayofmonth(d), "week_of_year": F.weekofyear(d),
        "day_name": F.date_format(d, "EEEE"), "is_weekend": F.dayofweek(d).isin(1, 7),
    }


def end_of_day(day: Column | str) -> Column:
    """23:59:59 of a day."""
    day = F.col(day) if isinstance(day, str) else day
    return day.cast("timestamp") + F.expr("INTERVAL 86399 SECONDS")
