"""Lake tables: folders of Parquet files, by date where they are partitioned. Paths may be of any Hadoop file system."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import merge_versions


#: What begins the name of a folder that a swap has moved aside; readers skip such names.
ASIDE = "._aside_"


class Lake:
    """Tables under ``root``: <root>/<layer>/[<source>/]<table>/[<column>=<day>/]."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path_class = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path_class(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path_class(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path_class(path), True)

    def folders(self, path: str) -> list[str]:
        """Sorted names of sub-folders; hidden and working ones aside."""
        if not self.exists(path):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path_class(path)) if s.isDirectory()]
        return sorted(x for x in found if x[0] not in "._")

    def swap(self, source: str, target: str) -> None:
        """Puts a staged folder in the place of another, which is moved aside first and deleted last: at any moment one of
        them is there whole. ``recover`` puts back what a failure between the steps left aside."""
        to = self._path_class(target)
        aside = self._path_class(f"{to.getParent().toString()}/{ASIDE}{to.getName()}")
        self.fs.mkdirs(to.getParent())
        self.recover(to.getParent().toString())
        if self.fs.exists(to) and not self.fs.rename(to, aside):
            raise OSError(f"{target} could not be moved aside")
        try:
            moved, why = self.fs.rename(self._path_class(source), to), None
        except Py4JJavaError as e:  # some file systems raise where others say no
            moved, why = False, e
        if not moved:
            self.recover(to.getParent().toString())
            raise OSError(f"{source} could not be moved to {target}") from why
        self.fs.delete(aside, True)

    def recover(self, folder: str) -> None:
        """Finishes swaps in a folder that were broken off: what was moved aside goes back where nothing is in its place."""
        if not self.exists(folder):
            return
        for status in self.fs.listStatus(self._path_class(folder)):
            name = status.getPath().getName()
            if name.startswith(ASIDE):
                place = self._path_class(f"{folder}/{name.removeprefix(ASIDE)}")
                if self.fs.exists(place):
                    self.fs.delete(status.getPath(), True)
                else:
                    self.fs.rename(status.getPath(), place)

    # scans

    def read(self, path: str) -> DataFrame | None:
        """The whole table, or None if it isn't there."""
        return self.spark.read.parquet(path) if self.exists(path) else None

    def read_range(self, path: str, low: date | None, high: date, column: str = "ingest_date") -> DataFrame | None:
        """Partitions in (low, high], with the partition column renamed to _bronze_ingest_date; None if there is no
        table. The bounds prune partitions before files are listed."""
        df = self.read(path)
        if df is None:
            return None
        df = df.where(F.col(column) <= F.lit(high).cast("date"))
        if low is not None:
            df = df.where(F.col(column) > F.lit(low).cast("date"))
        return df.withColumnRenamed(column, "_bronze_ingest_date")

    def partitions(self, path: str, column: str) -> list[date]:
        return sorted(date.fromisoformat(x.partition("=")[2]) for x in self.folders(path) if x.startswith(f"{column}=") and "__HIVE" not in x)

    def latest_snapshot(self, path: str, day: date, column: str = "ingest_date") -> DataFrame | None:
        """The newest partition up to ``day``."""
        days = [d for d in self.partitions(path, column) if d <= day]
        return self.spark.read.parquet(f"{path}/{column}={days[-1]}").withColumn(column, F.lit(days[-1]).cast("date")) if days else None

    def has_snapshot_in(self, path: str, low: date | None, high: date, column: str = "ingest_date") -> bool:
        return any((low is None or d > low) and d <= high for d in self.partitions(path, column))

    def as_of(self, path: str, day: date) -> DataFrame | None:
        """Rows that were first written by ``day``."""
        df = self.read(path)
        return df if df is None else df.where(F.col("_first_batch_date") <= F.lit(day).cast("date"))

    # writes

    def overwrite_partition(self, df: DataFrame, path: str, column: str, value: date) -> int:
        """Replaces one partition and no other, and returns its rows. No rows delete it."""
        target = f"{path}/{column}={value}"
        if df.isEmpty():
            self.delete(target)
            return 0
        out = df.drop(column).withColumn(column, F.lit(value).cast("date"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
        return self.spark.read.parquet(target).count()

    def write_batch(self, df: DataFrame, path: str, day: date, source: str, ingested_at: datetime) -> int:
        """Raw rows of one batch, with where and when they came from."""
        stamped = df.withColumns({"_ingested_at": F.lit(ingested_at).cast("timestamp"), "_batch_date": F.lit(day).cast("date"), "_source": F.lit(source)})
        return self.overwrite_partition(stamped, path, "ingest_date", day)

    def quarantine(self, df: DataFrame, path: str, day: date) -> int:
        """This batch's rejected (or pending) rows in place of those of an earlier run of it."""
        return self.overwrite_partition(df, path, "batch_date", day)

    def merge(self, new: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], partition: str | None = None, full_refresh: bool = False, union_existing: bool = True) -> int:
        """Upserts ``new``: in each partition that it touches the latest row of each key stays. Returns the rows written.

        The result is staged and then put in place partition by partition. A key must not move between partitions.
        ``union_existing=False`` replaces touched partitions; ``full_refresh`` replaces the table.
        """
        staging = self.path("_staging", uuid.uuid4().hex)
        old = None if full_refresh or not union_existing else self.read(path)
        if old is not None and partition:
            touched = [r[0] for r in new.select(partition).distinct().collect()]  # days of one batch
            old = old.where(F.col(partition).isin(touched)) if touched else old.limit(0)
        merged = merge_versions(new, old, list(keys), list(order))
        if partition:
            # Rebalanced, so that a very large day is split over several tasks and small ones get one file.
            merged.hint("rebalance", F.col(partition)).write.partitionBy(partition).parquet(staging)
        else:
            merged.write.parquet(staging)
        try:
            names = self.folders(staging) if partition else []
            rows = self.spark.read.parquet(staging).count() if names or not partition else 0
            if not partition or full_refresh:
                if rows or not partition:
                    self.swap(staging, path)
                else:
                    self.delete(path)
            else:
                for name in names:
                    self.swap(f"{staging}/{name}", f"{path}/{name}")
        finally:
            self.delete(staging)
        return rows

    def regroup(self, df: DataFrame, path: str, column: str, by: Column) -> None:
        """Writes ``df`` in coarser partitions, of one file each or several of the size that adaptive execution aims at."""
        df.withColumn(column, by).hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(path)


HIVE_TYPES = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}


def table_ddl(database: str, table: str, df: DataFrame, location: str, partition: str | None = None) -> str:
    """CREATE EXTERNAL TABLE from a frame's schema, so that it can't drift from the files."""
    kind = lambda f: HIVE_TYPES.get(f.dataType.typeName(), f.dataType.simpleString())
    columns = ",\n".join(f"  `{f.name}` {kind(f)}" for f in df.schema if f.name != partition)
    parted = f"\nPARTITIONED BY (`{partition}` {kind(df.schema[partition])})" if partition else ""
    return f"CREATE EXTERNAL TABLE IF NOT EXISTS `{database}`.`{table}` (\n{columns}\n){parted}\nSTORED AS PARQUET\nLOCATION '{location}'"


def add_partitions_ddl(database: str, table: str, partition: str, values: Sequence[str], location: str, batch: int = 100) -> list[str]:
    """ALTER TABLE statements that register partitions, ``batch`` in each."""
    one = lambda v: f"PARTITION (`{partition}`='{v}') LOCATION '{location}/{partition}={v}/'"
    return [f"ALTER TABLE `{database}`.`{table}` ADD IF NOT EXISTS " + " ".join(map(one, values[i : i + batch])) for i in range(0, len(values), batch)]


def register(spark: SparkSession, name: str, path: str) -> None:
    """A temporary view over a table's files."""
    spark.read.parquet(path).createOrReplaceTempView(name)
