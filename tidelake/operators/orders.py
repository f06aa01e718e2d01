"""Order lines: exact allocation of payments, and the wide join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import payments_per_order
from .joins import lookup
from .replay import MILESTONES

MONEY = "decimal(12,2)"


def allocate_payment(lines: DataFrame, order: str = "order_id", line: str = "order_item_id", amount: str = "line_total", payment: str = "payment_total", name: str = "allocated_payment") -> DataFrame:
    """Splits each order's payment over its lines in proportion to their amounts, to the cent.

    Every line but the last (greatest line number) gets its share rounded half up, the last one the rest, so the parts
    sum to the payment. If the amounts sum to nothing, shares are equal. Without a payment all parts are null. Shares
    are doubles, and so is the product that is rounded.
    """
    whole = Window.partitionBy(order)
    last = F.row_number().over(whole.orderBy(F.desc(line))) == 1
    total, n = F.sum(amount).over(whole), F.count("*").over(whole)
    share = F.when(total > 0, (F.col(amount) / total).cast("double")).otherwise(F.lit(1).cast("double") / n)
    cents = F.round(F.col(payment) * share, 2).cast(MONEY)
    staged = lines.withColumns({"_last": last, "_part": cents})
    rest = F.col(payment) - F.coalesce(F.sum(F.when(~F.col("_last"), F.col("_part"))).over(whole), F.lit(0).cast(MONEY))
    return staged.withColumn(name, F.when(F.col("_last"), rest).otherwise(F.col("_part")).cast(MONEY)).drop("_last", "_part")


def order_lines(items: DataFrame, orders: DataFrame, payments: DataFrame, customers: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """The wide table: items with their order (inner), payment totals (left), and attributes of customer, product and
    seller (left). Payments are aggregated first, so that nothing fans out."""
    head = orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp", F.to_date("order_purchase_timestamp").alias("order_purchase_date"), *MILESTONES, "order_estimated_delivery_date")
    joined = items.select("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value").join(head, "order_id").join(payments_per_order(payments), "order_id", "left")
    joined = lookup(joined, customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"), ["customer_id"])
    joined = lookup(joined, products.select("product_id", "product_category_name", "product_category_name_english"), ["product_id"])
    joined = lookup(joined, sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"), ["seller_id"])
    return allocate_payment(joined.withColumn("line_total", (F.col("price") + F.col("freight_value")).cast(MONEY)))


def without_lines(orders: DataFrame, lines: DataFrame, key: str = "order_id") -> DataFrame:
    return orders.join(lines.select(key).distinct(), key, "left_anti")


def affected_days(changed: Sequence[DataFrame], day: str = "order_purchase_date") -> DataFrame:
    """The distinct days that any of the changed tables touches."""
    out = changed[0].select(day)
    for other in changed[1:]:
        out = out.unionByName(other.select(day))
    return out.where(F.col(day).isNotNull()).distinct()


def lateness_days(delivered: Column, promised: Column) -> Column:
    """Days after the promised date; negative if early."""
    return F.datediff(delivered, promised)
