"""A source system played back day by day: what changed on a day is upserted as it was known then."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import end_of_day
from ..operators.replay import change_days, guarded_upsert, insert_if_absent, order_as_of


def day_of_orders(orders: DataFrame, day: date) -> DataFrame:
    """Orders that were bought or changed on ``day``, as they stood at its end, stamped with it."""
    today = F.lit(day).cast("date")
    changed = change_days(orders).where(F.col("day") == today).select("order_id")
    return order_as_of(orders.join(changed, "order_id", "left_semi"), today).withColumn("updated_at", end_of_day(today))


def replay_day(state: dict[str, DataFrame], source: dict[str, DataFrame], day: date) -> dict[str, DataFrame]:
    """The source tables after ``day``: orders are upserted if newer and different; the customers, items and payments of
    orders that are there are inserted if absent. Replaying a day again changes nothing."""
    stamp = end_of_day(F.lit(day))
    orders = day_of_orders(source["orders"], day)
    out = dict(state)
    out["orders"] = guarded_upsert(state["orders"], orders.select(*state["orders"].columns), ["order_id"], "updated_at")
    for name, keys, link in (("customers", ["customer_id"], "customer_id"), ("order_items", ["order_id", "order_item_id"], "order_id"), ("order_payments", ["order_id", "payment_sequential"], "order_id")):
        if name in source:
            new = source[name].join(orders.select(link).distinct(), link, "left_semi").withColumn("updated_at", stamp)
            out[name] = insert_if_absent(state[name], new.select(*state[name].columns), keys)
    return out


