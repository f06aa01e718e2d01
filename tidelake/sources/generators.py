"""Generators of dirty test sources, from hashes of keys: the same rows in each run, made on the executors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chance that a customer is active, by days since the last order.
ACTIVE = ((7, 0.15), (30, 0.02))
REST = 0.001


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def activity_probability(days: Column) -> Column:
    """Of no order yet: null."""
    return F.when(days < ACTIVE[0][0], ACTIVE[0][1]).when(days < ACTIVE[1][0], ACTIVE[1][1]).when(days.isNotNull(), REST)


def customer_activity(orders: DataFrame, day: date, dirty: float = 0.05) -> DataFrame:
    """A day's activity of customers, as texts. A share ``dirty`` lacks a field, has negative sessions, or another time
    format."""
    today, key = F.lit(day).cast("date"), "customer_unique_id"
    last = orders.where(F.to_date("order_purchase_timestamp") <= today).groupBy(key).agg(F.max(F.to_date("order_purchase_timestamp")).alias("_last"))
    of = lambda kind: unit(F.lit(kind), today.cast("string"), key)
    active = last.where(of("active") < activity_probability(F.datediff(today, "_last")))
    number = lambda kind, most: F.floor(of(kind) * most).cast("int")
    kind = F.when(of("dirty") < dirty, F.floor(of("kind") * 3)).otherwise(-1)
    seen = F.timestamp_seconds(F.unix_timestamp(today.cast("timestamp")) + number("second", 86400))
    text = lambda c: c.cast("string")
    return active.select(
        key, F.lit(str(day)).alias("activity_date"), text(F.when(kind == 1, -1 - number("sessions", 4)).otherwise(1 + number("sessions", 4))).alias("sessions"),
        text(F.when(kind == 0, F.lit(None)).otherwise(number("views", 40))).alias("page_views"), text(number("cart", 5)).alias("cart_adds"), text(number("ticket", 2)).alias("support_tickets"),
        F.when(kind == 2, F.date_format(seen, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(seen, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("last_seen_at"), F.when(of("device") < 0.6, "mobile").otherwise("desktop").alias("device"),
    )


def customer_changes(customers: DataFrame, addresses: DataFrame, day: date, rate: float = 0.01, dirty: float = 0.1) -> DataFrame:
    """A day's change requests: a share ``rate`` of known customers moves to an address of the pool. A share ``dirty`` is
    doubled, has a messy state, lacks its city, or is of an unknown customer."""
    from ..operators.aggregates import global_rank

    key, today = "customer_unique_id", F.lit(str(day))
    pool = global_rank(addresses, [F.col(c) for c in addresses.columns], "_n").toDF("new_zip_code_prefix", "new_city", "new_state", "_n")
    size = pool.count()
    of = lambda kind: unit(F.lit(kind), today, key)
    moving = customers.select(key).distinct().where(of("moves") < rate).withColumn("_n", (1 + F.floor(of("to") * size)).cast("long"))
    kind = F.when(of("dirty") < dirty, F.floor(of("kind") * 4)).otherwise(-1)
    rows = moving.join(pool, "_n").withColumn("_kind", kind)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(day).cast("date").cast("timestamp")) + F.floor(of("second") * 86400).cast("int"))
    out = rows.select(
        F.md5(F.concat_ws("|", today, key)).alias("change_id"), F.when(F.col("_kind") == 3, F.concat(F.lit("ghost-"), key)).otherwise(F.col(key)).alias(key), "new_zip_code_prefix",
        F.when(F.col("_kind") != 2, F.col("new_city")).alias("new_city"), F.when(F.col("_kind") == 1, F.concat(F.lit(" "), F.lower("new_state"), F.lit(" "))).otherwise(F.col("new_state")).alias("new_state"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("requested_at"), F.lit("crm_portal").alias("source"), "_kind",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 0, 2).otherwise(1)))).drop("_kind", "_copy")
