"""Joins. A side is broadcast only after its rows and bytes were counted against bounds; beyond that Spark shuffles it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import salt

#: Rows of a side that are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most BROADCAST_BYTES together, by the default sizes of
    their columns and the lengths of their texts; counting stops there."""
    texts = [F.octet_length(F.col(f"`{f.name}`").cast("binary") if f.dataType.typeName() == "string" else F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    plain = 16 * (len(df.columns) + 1)
    size = F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(plain)))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


def lookup(df: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attributes of a dimension for each row."""
    return df.join(small(dimension, rows), list(keys), how)


def with_exists(df: DataFrame, parents: DataFrame, keys: Sequence[str], flag: str = "_known", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``flag``: whether the row's key is among the parents'. Rows keep their number; null keys aren't known."""
    known = parents.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(small(known, rows), list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def orphans(df: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key no parent has."""
    return df.join(parents.select(*keys).distinct(), list(keys), "left_anti")


def temporal_lookup(df: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, start: str = "valid_from", end: str = "valid_to", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each row with the version of its key that held at its time: start <= at < end. The key makes it an equi-join with
    a residual condition; a row without such a version keeps nulls."""
    there = {k: f"_v_{k}" for k in keys}
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(there[k]))
    on = on & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return df.join(small(versions.withColumnsRenamed(there), rows), on, "left").drop(*there.values())


def replicate(df: DataFrame, copies: int, number: str = "copy") -> DataFrame:
    """Each row ``copies`` times, numbered from 0; generated in place, with no join."""
    return df.withColumn(number, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def salted_join(large: DataFrame, other: DataFrame, keys: Sequence[str], buckets: int, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which each key's rows of ``large`` are dealt to ``buckets`` tasks by the columns ``spread``, and the
    other side is repeated for each. ``how`` may be inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}: rows of the repeated side would come out more than once")
    left = large.withColumn("_salt", salt(buckets, *spread))
    return left.join(replicate(other, buckets, "_salt"), [*keys, "_salt"], how).drop("_salt")


def compare_outer(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of either side with ``value`` of both (left_value, right_value) and whether they agree, nulls included."""
    l, r = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))  # noqa: E741
    return l.join(r, list(keys), "full_outer").withColumn("agrees", F.col("left_value").eqNullSafe(F.col("right_value")))


def distinct_from(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM; on structs, row by row."""
    return ~a.eqNullSafe(b)
