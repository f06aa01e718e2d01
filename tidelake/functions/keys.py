"""Keys from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(kind: str, *columns: Column | str) -> Column:
    """A deterministic 64-bit key of a natural key; ``kind`` keeps the keys of different tables apart."""
    return F.xxhash64(F.lit(kind), *columns)


def salt(buckets: int, *columns: Column | str) -> Column:
    """A number under ``buckets`` from the columns, the same in each run and retry."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def content_hash_column(*columns: str) -> Column:
    """md5 of a row's columns as text, nulls told from empty texts."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
