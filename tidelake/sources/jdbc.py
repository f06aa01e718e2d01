"""Databases: options, windows as query text, partitioned reads, and snapshots that are skipped if nothing changed."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from ..operators.aggregates import content_hash

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def identifier(name: str) -> str:
    """The name, if it is one that needs no quoting."""
    if not NAME.match(name):
        raise ValueError(f"{name!r} is no plain identifier")
    return name


def reader(spark: SparkSession, url: str, user: str, password: str, driver: str = "org.postgresql.Driver", fetch: int = 10_000, **more: str) -> DataFrameReader:
    return spark.read.format("jdbc").options(url=url, user=user, password=password, driver=driver, fetchsize=str(fetch), **more)


@dataclass(frozen=True)
class Window:
    """Changes in (low, high]; no low is everything up to high."""

    high: datetime
    low: datetime | None = None

    def sql(self, column: str) -> str:
        c = identifier(column)
        above = f"{c} > TIMESTAMP '{self.low:%Y-%m-%d %H:%M:%S}' AND " if self.low else ""
        return f"{above}{c} <= TIMESTAMP '{self.high:%Y-%m-%d %H:%M:%S}'"


def incremental_query(schema: str, table: str, window: Window, column: str = "updated_at") -> str:
    """The query that the database runs, so that only the window's rows leave it."""
    return f"SELECT * FROM {identifier(schema)}.{identifier(table)} WHERE {window.sql(column)}"


def read_incremental(source: DataFrameReader, schema: str, table: str, window: Window) -> DataFrame:
    return source.option("query", incremental_query(schema, table, window)).load()


def read_partitioned(source: DataFrameReader, table: str, column: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A table read by ``parts`` connections, each a range of an integer column."""
    return source.options(dbtable=table, partitionColumn=identifier(column), lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)).load()


def windowed(df: DataFrame, window: Window, column: str = "updated_at") -> DataFrame:
    """The window over a file source; the condition reaches the Parquet scan."""
    return df.where(window.sql(column))


def changed_snapshot(df: DataFrame, known_hash: str | None) -> tuple[str, bool]:
    """(content hash, whether it differs from the known one)."""
    found = content_hash(df, sorted(df.columns)).first()["content_md5"]
    return found, found != known_hash
