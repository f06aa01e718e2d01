"""One row per key: latest, first, most frequent; and numbering and interval closing over a key's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, which should be total. Null keys are one group. Spark keeps only n
    rows a key in each task before the shuffle (WindowGroupLimit)."""
    name = "_rank"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n).drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that ``order``, newest first, puts first."""
    return top_per_key(df, keys, order)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (rows, unique_keys, duplicates) in one pass; null keys are one key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("unique_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, of equals the smallest; nulls count as a value only if there is no other."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return top_per_key(counts, keys, [F.col(value).isNull(), F.desc("_n"), F.col(value)]).drop("_n")


def first_seen(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``column`` replaced by its least value over the key."""
    return df.withColumn(column, F.min(column).over(Window.partitionBy(*keys)))


def number_versions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "version") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def close_intervals(df: DataFrame, keys: Sequence[str], start: str, open_end: Column, end: str = "valid_to") -> DataFrame:
    """Adds the end of each row's interval: the start of the key's next row, or ``open_end``."""
    return df.withColumn(end, F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)), open_end))
