"""Where rows go: valid, quarantined, pending; and the accounts of it.

Each function tags rows in one pass instead of running one pass for each outcome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Column]]
REASON = "_reason"


def first_failure(rules: Rules) -> Column:
    """The name of the first rule that is true, or null; a rule that is null doesn't fire."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules]) if rules else F.lit(None).cast("string")


def tag(df: DataFrame, rules: Rules, reason: str = REASON) -> DataFrame:
    return df.withColumn(reason, first_failure(rules))


def split_quarantine(df: DataFrame, rules: Rules, reason: str = REASON) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reason, rejected rows with it)."""
    tagged = tag(df, rules, reason)
    return tagged.where(F.col(reason).isNull()).drop(reason), tagged.where(F.col(reason).isNotNull())


def split_corrupt(df: DataFrame, corrupt: str = "_corrupt_record", reason: str = REASON) -> tuple[DataFrame, DataFrame]:
    """(rows that were read whole, the others with the reason corrupt_record)."""
    return df.where(F.col(corrupt).isNull()), df.where(F.col(corrupt).isNotNull()).withColumn(reason, F.lit("corrupt_record"))


def late_status(reason: Column, first_seen: Column, today: Column, waiting: Sequence[str] = ("orphan_order", "orphan_customer"), days: int = 7) -> Column:
    """valid, pending or quarantined. A row whose parent is missing waits until it is ``days`` days old."""
    young = F.coalesce(F.datediff(today, first_seen) < days, F.lit(False))
    return F.when(reason.isNull(), "valid").when(reason.isin(*waiting) & young, "pending").otherwise("quarantined")


def accounting(df: DataFrame, status: str, keys: Sequence[str]) -> DataFrame:
    """One row: rows_in = rows_valid (unique keys) + rows_duplicate + rows_quarantined + rows_pending, in one pass."""
    per = df.groupBy(status, *keys).agg(F.count("*").alias("n"))
    total = lambda name, x: F.coalesce(F.sum(F.when(F.col(status) == name, x)), F.lit(0)).cast("long")
    n = F.col("n")
    return per.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("rows_in"), total("valid", F.lit(1)).alias("rows_valid"), total("valid", n - 1).alias("rows_duplicate"),
        total("quarantined", n).alias("rows_quarantined"), total("pending", n).alias("rows_pending"),
    )


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows have each flag true; a null is not."""
    return df.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])
