"""The star schema from cleaned tables: dimensions whole, fact and aggregate partitions that were touched, a snapshot."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dims, metrics
from ..operators.cleaning import add_row_metadata
from ..sources.lake import Lake
from .ledger import IngestRange, LayerRun, Ledger

CALENDAR = (date(2016, 1, 1), date(2018, 12, 31))


class GoldJob:
    def __init__(self, lake: Lake, ledger: Ledger, day: date, full_refresh: bool = False, calendar: tuple[date, date] = CALENDAR):
        self.lake, self.ledger, self.day, self.full_refresh, self.calendar = lake, ledger, day, full_refresh, calendar

    def _silver(self, name: str) -> DataFrame:
        return self.lake.read(self.lake.path("silver", name))

    def _stamped(self, df: DataFrame) -> DataFrame:
        return add_row_metadata(df, F.lit(self.day), F.lit(datetime.now(UTC).replace(tzinfo=None)))

    def _replace(self, name: str, df: DataFrame, keys: list[str]) -> None:
        self._done(name, self.lake.merge(self._stamped(df), self.lake.path("gold", name), keys, [F.desc("_batch_date")], full_refresh=True))

    def _done(self, name: str, rows: int) -> None:
        self.ledger.record("gold", name, self.day, IngestRange(self.day), LayerRun(rows_in=rows, rows_valid=rows, rows_written=rows))

    def run(self) -> None:
        spark, gold = self.lake.spark, lambda n: self.lake.path("gold", n)
        self._replace("dim_date", dims.dim_date(spark, *self.calendar), ["date_key"])
        self._replace("dim_product", dims.dim_product(self._silver("products")), ["product_sk"])
        self._replace("dim_seller", dims.dim_seller(self._silver("sellers"), self._silver("geolocation")), ["seller_sk"])
        changes = self._silver("customer_changes")
        if changes is None:
            changes = spark.createDataFrame([], "change_id string, customer_unique_id string, new_zip_code_prefix string, new_city string, new_state string, requested_at timestamp")
        self._replace("dim_customer", dims.dim_customer(self._silver("orders"), self._silver("customers"), changes), ["customer_sk"])

        lines = self._silver("order_lines")
        touched = lines if self.full_refresh else lines.where(F.col("_batch_date") == F.lit(self.day).cast("date"))
        days = [r[0] for r in touched.select("order_purchase_date").distinct().collect()]
        if days:
            wanted = F.col("order_purchase_date").isin(days)
            fact = dims.fact_order_lines(lines.where(wanted), self.lake.read(gold("dim_customer")))
            write = {"partition": "order_purchase_date", "union_existing": False, "full_refresh": self.full_refresh}
            self._done("fact_order_lines", self.lake.merge(self._stamped(fact), gold("fact_order_lines"), ["order_id", "order_item_id"], [F.desc("_batch_date")], **write))
            fact = self.lake.read(gold("fact_order_lines"))
            sales = metrics.daily_category_sales(fact.where(wanted), self.lake.read(gold("dim_product")))
            self._done("agg_daily_category_sales", self.lake.merge(self._stamped(sales), gold("agg_daily_category_sales"), ["order_purchase_date", "category"], [F.desc("_batch_date")], **write))
        fact = self.lake.read(gold("fact_order_lines"))
        if fact is not None:
            found = metrics.customer_metrics(fact, F.lit(self.day).cast("date"))
            self._done("customer_metrics", self.lake.overwrite_partition(found, gold("customer_metrics"), "as_of_date", self.day))
