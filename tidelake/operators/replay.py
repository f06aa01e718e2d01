"""What was known of an order on a day, and writes that respect order in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milestones in order, with the status that reaching each gives.
MILESTONES = {"order_approved_at": "approved", "order_delivered_carrier_date": "shipped", "order_delivered_customer_date": "delivered"}


def derive_status(visible: dict[str, Column]) -> Column:
    """The status of the furthest milestone that is visible; created without one."""
    furthest = [F.when(visible[c].isNotNull(), F.lit(s)) for c, s in reversed(MILESTONES.items())]
    return F.coalesce(*furthest, F.lit("created"))


def order_as_of(orders: DataFrame, day: Column) -> DataFrame:
    """Orders as they stood at the end of ``day``: later milestones are hidden, and if any is, the status is that of what
    remains; else it is the final one. Orders bought later are left out."""
    hidden = {c: F.to_date(c) > day for c in MILESTONES}
    visible = {c: F.when(~F.coalesce(hidden[c], F.lit(False)), F.col(c)) for c in MILESTONES}
    any_hidden = F.greatest(*[F.coalesce(h, F.lit(False)) for h in hidden.values()])
    status = F.when(any_hidden, derive_status(visible)).otherwise(F.col("order_status"))
    return orders.where(F.to_date("order_purchase_timestamp") <= day).withColumns({**visible, "order_status": status})


def change_days(orders: DataFrame, *keep: Column) -> DataFrame:
    """(order_id, day), and what else is to be kept, of the purchase and of each later milestone."""
    bought = F.to_date("order_purchase_timestamp")
    days = F.array_distinct(F.array(bought, *[F.greatest(F.to_date(c), bought) for c in MILESTONES]))
    return orders.select("order_id", *keep, F.explode(days).alias("day")).where(F.col("day").isNotNull())


def review_release_day(review: Column, purchase: Column) -> Column:
    return F.greatest(F.to_date(review), F.to_date(purchase))


def daily_index(orders: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Per day: the orders bought, those changed later, and the reviews released. A day's lists are as long as the day."""
    days = change_days(orders, F.to_date("order_purchase_timestamp").alias("bought"))
    events = days.select("day", F.when(F.col("day") == F.col("bought"), F.col("order_id")).alias("bought"), F.when(F.col("day") != F.col("bought"), F.col("order_id")).alias("changed"), F.lit(None).cast("string").alias("review"))
    if reviews is not None:
        released = reviews.join(orders.select("order_id", "order_purchase_timestamp"), "order_id")
        events = events.unionByName(released.select(review_release_day(F.col("review_creation_date"), F.col("order_purchase_timestamp")).alias("day"), F.lit(None).cast(dict(events.dtypes)["bought"]).alias("bought"), F.lit(None).cast(dict(events.dtypes)["changed"]).alias("changed"), F.col("review_id").cast("string").alias("review")))
    lists = [F.sort_array(F.collect_list(c)).alias(n) for c, n in (("bought", "purchased"), ("changed", "changed"), ("review", "reviews"))]
    return events.groupBy("day").agg(*lists)


def known_customers(orders: DataFrame, day: Column, key: str = "customer_unique_id") -> DataFrame:
    """Customers whose first purchase was by ``day``, with that day."""
    first = orders.groupBy(key).agg(F.min(F.to_date("order_purchase_timestamp")).alias("first_day"))
    return first.where(F.col("first_day") <= day)


def guarded_upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``existing`` with rows of ``new`` put in: an absent key is added; a present one is replaced only by a newer version
    that differs in something else. Neither side may repeat a key. Replays and late rows change nothing."""
    columns = existing.columns
    values = [c for c in columns if c not in (*keys, version)]
    both = existing.withColumn("_old", F.struct(*columns)).select(*keys, "_old").join(new.withColumn("_new", F.struct(*columns)).select(*keys, "_new"), list(keys), "full_outer")
    same = F.struct(*[F.col(f"_old.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"_new.{c}") for c in values])) if values else F.lit(True)
    newer = F.coalesce(F.col(f"_new.{version}") > F.col(f"_old.{version}"), F.lit(False))
    take = F.col("_old").isNull() | (F.col("_new").isNotNull() & newer & ~same)
    return both.select(F.when(take, F.col("_new")).otherwise(F.col("_old")).alias("_row")).select("_row.*")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` and the rows of ``new`` whose key it lacks."""
    return existing.unionByName(new.select(*existing.columns).join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))
