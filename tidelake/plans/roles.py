"""The test tables in the roles of the order model, and the same as SQL common table expressions.

lineitem holds versions of order items (its key repeats); orders with status P are no sales; parts are products,
suppliers sellers, nations states; signup events are address changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import latest_per_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, times as timestamps of the session (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})



def line_order() -> list:
    return [F.desc("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled once, by order, which serves the latest version of each line, the join with orders, and sums by order."""
    latest = latest_per_key(table(spark, sf_dir, "lineitem").repartition("l_orderkey"), ["l_orderkey", "l_linenumber"], line_order())
    return latest.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"), (F.col("l_tax") * 100).cast("decimal(10,2)").alias("freight_value"), "l_shipdate", F.col("l_shipdate").alias("shipping_limit_date"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery is 20 days after an approval on the next day; promised are 15 to 24 days."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "canceled").when(F.col("o_orderstatus") == "F", "delivered").otherwise("shipped")
    day = lambda n: F.col("o_orderdate") + F.make_interval(days=n if not isinstance(n, int) else F.lit(n))
    out = o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), status.alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"),
        day(1).alias("order_approved_at"), day(5).alias("order_delivered_carrier_date"), F.when(status == "delivered", day(20)).alias("order_delivered_customer_date"),
        day((F.lit(15) + F.col("o_orderkey") % 10).cast("int")).alias("order_estimated_delivery_date"), F.col("o_totalprice").cast("decimal(12,2)").alias("paid"), "o_orderpriority",
    )
    return out


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit("credit_card").alias("payment_type"), F.lit(1).alias("payment_installments"), F.col("o_totalprice").cast("decimal(10,2)").alias("payment_value"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"), F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"), F.col("c_mktsegment").alias("customer_city"), F.col("n_name").alias("customer_state"))  # fmt: skip  nations are 25 rows at any scale


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"), F.col("p_type").alias("product_category_name_english"), F.col("p_size").alias("product_weight_g"), *[F.lit(None).cast("int").alias(f"product_{c}") for c in ("length_cm", "height_cm", "width_cm", "photos_qty")])


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"), F.col("s_name").alias("seller_city"), F.col("n_name").alias("seller_state"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as moves to one of 25 nations, long before or after orders: dates are moved back to 1997."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.col("event_id").cast("string").alias("change_id"), F.col("user_id").alias("customer_unique_id"), (F.col("event_id") % 25).cast("string").alias("new_zip_code_prefix"), F.concat(F.lit("city"), (F.col("event_id") % 7).cast("string")).alias("new_city"), F.concat(F.lit("state"), (F.col("event_id") % 5).cast("string")).alias("new_state"), (F.col("ts") - F.expr("INTERVAL 9000 DAYS")).alias("requested_at"))


ITEMS = """items AS (SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice::decimal(10,2) AS price, (l_tax * 100)::decimal(10,2) AS freight_value, l_shipdate
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"""
ORDERS = """ord AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CASE o_orderstatus WHEN 'P' THEN 'canceled' WHEN 'F' THEN 'delivered' ELSE 'shipped' END AS order_status, o_orderdate AS t0,
  o_orderdate + INTERVAL 1 DAY AS approved, o_orderdate + INTERVAL 5 DAY AS carrier, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 20 DAY END AS delivered, o_orderdate + (INTERVAL 1 DAY) * (15 + o_orderkey % 10) AS promised, o_totalprice::decimal(12,2) AS paid, o_orderpriority FROM orders)"""
CHANGES = """chg AS (SELECT event_id::varchar AS change_id, user_id AS customer_id, (event_id % 25)::varchar AS zip, 'city' || (event_id % 7) AS city, 'state' || (event_id % 5) AS state, ts - INTERVAL 9000 DAY AS t0 FROM events WHERE event_type = 'signup')"""
VERSIONS = f"""{ORDERS}, {CHANGES},
first AS (SELECT o.*, c_nationkey::varchar AS zip, c_mktsegment AS city, n_name AS state FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t0, order_id) AS rn FROM ord) o JOIN customer ON c_custkey = customer_id JOIN nation ON n_nationkey = c_nationkey WHERE rn = 1),
ev AS (SELECT customer_id, t0, zip, city, state, 0 AS p, order_id::varchar AS s FROM first UNION ALL SELECT c.customer_id, greatest(c.t0, f.t0), c.zip, c.city, c.state, 1, strftime(c.t0, '%Y-%m-%d %H:%M:%S.%f') || '|' || c.change_id FROM chg c JOIN first f ON f.customer_id = c.customer_id),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, t0 ORDER BY p DESC, s DESC) AS rn FROM ev) WHERE rn = 1),
dif AS (SELECT *, lag((zip, city, state)) OVER (PARTITION BY customer_id ORDER BY t0) AS was, row_number() OVER (PARTITION BY customer_id ORDER BY t0) AS k FROM one),
ver AS (SELECT customer_id, zip, city, state, t0 AS valid_from, coalesce(lead(t0) OVER (PARTITION BY customer_id ORDER BY t0), TIMESTAMP '9999-12-31') AS valid_to, row_number() OVER (PARTITION BY customer_id ORDER BY t0) AS version FROM dif WHERE k = 1 OR was IS DISTINCT FROM (zip, city, state))"""
