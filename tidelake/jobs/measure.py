"""Plain against salted: wall times with adaptive execution off and on, and how evenly rows are dealt."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import rows_per_partition


@dataclass
class Measurement:
    name: str
    adaptive: bool
    seconds: float
    largest_share: float


def measure(spark: SparkSession, variants: dict[str, Callable[[], DataFrame]], runs: int = 3) -> list[Measurement]:
    """The median time of computing each variant in full with no output, and the share of its rows that the fullest task
    of its last stage has."""
    before, out = spark.conf.get("spark.sql.adaptive.enabled"), []
    try:
        for adaptive in (False, True):
            spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
            for name, make in variants.items():
                took = []
                for _ in range(runs):
                    began = time.perf_counter()
                    make().write.format("noop").mode("overwrite").save()
                    took.append(time.perf_counter() - began)
                share = rows_per_partition(make()).agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0))).first()[0]
                out.append(Measurement(name, adaptive, median(took), share))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return out


def same_summary(a: DataFrame, b: DataFrame, keys: list[str], value: str, places: int = 6) -> bool:
    """Whether two results have the same rows and rounded sums by key."""
    def of(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(value).cast("double"), places).alias("v"))

    from ..operators.verify import same_rows

    return same_rows(of(a), of(b))
