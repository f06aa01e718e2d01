"""Reconciliation: equal tables, differences by key, valid versions, sums that agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregates import content_hash, fingerprint
from .joins import compare_outer
from .routing import REASON


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often, columns being matched by name."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    return multiset_difference(a, b).isEmpty()


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are more frequent in one frame, with ``surplus`` (positive: in ``a``). One shuffle for both directions."""
    names = list(a.columns)
    both = a.select(*names, F.lit(1).alias("surplus")).unionByName(b.select(*names, F.lit(-1).alias("surplus")))
    return both.groupBy(*names).agg(F.sum("surplus").alias("surplus")).where("surplus != 0")


def keyed_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, extra or different, as (keys, kind). Columns of ``expected`` are compared, nulls equal."""
    values = [c for c in expected.columns if c not in keys]
    pack = F.struct(*values) if values else F.struct(F.lit(1))
    l, r = expected.select(*keys, pack.alias("_l")), actual.select(*keys, pack.alias("_r"))  # noqa: E741
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(~F.col("_l").eqNullSafe(F.col("_r")), "different")
    return l.join(r, list(keys), "full_outer").select(*keys, kind.alias("kind")).where(F.col("kind").isNotNull())


def lake_snapshot(tables: dict[str, DataFrame], ignore: Sequence[str] = ("_processed_at",)) -> DataFrame:
    """(table, rows, total) of each table, without processing columns: equal before and after a rerun."""
    out = None
    for name, df in tables.items():
        one = fingerprint(df, ignore).select(F.lit(name).alias("table"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


def lookup_is_valid(facts: DataFrame, versions: DataFrame, at: str = "order_purchase_timestamp", key: str = "customer_sk") -> DataFrame:
    """One row: facts, and those whose version is missing or didn't hold at their time."""
    found = facts.select(key, at).join(versions.select(key, "valid_from", "valid_to"), key, "left")
    holds = F.coalesce((F.col(at) >= F.col("valid_from")) & (F.col(at) < F.col("valid_to")), F.lit(False))
    return found.agg(F.count("*").alias("facts"), F.count_if(~holds).alias("invalid"))


def sums_agree(parts: DataFrame, wholes: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """Keys whose parts don't sum to the whole, nulls being nothing."""
    added = parts.groupBy(key).agg(F.sum(part).alias(whole))
    return compare_outer(added, wholes.select(key, whole), [key], whole).where(~F.coalesce("left_value", F.lit(0)).eqNullSafe(F.coalesce("right_value", F.lit(0))))


def allocation_gaps(lines: DataFrame) -> DataFrame:
    """Orders whose allocated parts don't sum to their payment exactly."""
    per = lines.groupBy("order_id").agg(F.sum("allocated_payment").alias("allocated"), F.first("payment_total").alias("paid"))
    return per.where(F.col("paid").isNotNull() & (F.col("allocated") != F.col("paid")))


def reason_counts(rejected: DataFrame, reason: str = "_reason") -> DataFrame:
    return rejected.groupBy(reason).agg(F.count("*").alias("rows"))


def dirt_difference(rejected: DataFrame, dirt: DataFrame, reason: str = REASON) -> DataFrame:
    """(reason, left_value, right_value): where the rejected rows of a reason aren't as many as ``dirt`` (reason, rows), which
    was counted at the source by itself, says."""
    return compare_outer(reason_counts(rejected, reason), dirt.select(reason, "rows"), [reason], "rows").where("NOT agrees")


def partition_difference(table: DataFrame, recorded: DataFrame, partition: str) -> DataFrame:
    """Partitions whose rows aren't as many as the ledger recorded (partition, rows)."""
    held = table.groupBy(partition).agg(F.count("*").alias("rows"))
    return compare_outer(held, recorded.select(partition, "rows"), [partition], "rows").where("NOT agrees")


def latest_difference(source: DataFrame, cleaned: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keys whose newest version at the source isn't the one that the cleaned table has."""
    newest = source.groupBy(*keys).agg(F.max(version).alias("at"))
    return compare_outer(newest, cleaned.select(*keys, F.col(version).alias("at")), list(keys), "at").where("NOT agrees")


def files_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, content_md5) of the files under a folder, by their relative paths and contents: equal before and after
    whatever shouldn't touch them. Files are read as one value each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "[^/]+/[^/]+$", 0)
    return content_hash(files.select(name.alias("name"), F.md5("content").alias("md5")), ["name", "md5"]).withColumnRenamed("rows", "files")
