"""The star schema, its metrics and its KPIs, over the test tables in their roles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims, joins, metrics, verify
from ..operators.orders import lateness_days, order_lines
from . import roles
from .registry import query
from .roles import ITEMS, ORDERS, VERSIONS, table

#: Calendar days of the KPI snapshots.
AS_OF = date(1999, 12, 31)


def _sales(spark: SparkSession, d: str) -> DataFrame:
    """Facts without customer versions; product ids stand for their keys."""
    o = roles.orders(spark, d).select("order_id", "customer_id", "order_status", F.to_date("order_purchase_timestamp").alias("order_purchase_date"), "paid")
    return roles.items(spark, d).join(o, "order_id").withColumn("product_sk", F.col("product_id"))


def _products(spark: SparkSession, d: str) -> DataFrame:
    return roles.products(spark, d).withColumn("product_sk", F.col("product_id"))


_SALES = f"""{ITEMS}, {ORDERS}, sold AS (SELECT t0::date AS day, coalesce(p_type, 'unknown') AS category, order_id, price, freight_value FROM items JOIN ord USING (order_id) JOIN part ON p_partkey = product_id WHERE order_status <> 'canceled'),
daily AS (SELECT day, category, count(DISTINCT order_id) AS orders, count(*) AS items, sum(price) AS revenue, sum(freight_value) AS freight, ((2 * (sum(price) * 100)::bigint + count(*)) // (2 * count(*)))::decimal(18,0) * 0.01 AS mean FROM sold GROUP BY day, category)"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_category_sales(_sales(spark, d), _products(spark, d))


@query(f"WITH {_SALES} SELECT day AS order_purchase_date, category, orders, items, revenue::double AS revenue, freight::double AS freight, (revenue + freight)::double AS gmv, mean::double AS avg_item_price FROM daily")
def daily_category_sales(spark: SparkSession, d: str) -> DataFrame:
    out = _daily(spark, d)
    return out.withColumns({c: F.col(c).cast("double") for c in ("revenue", "freight", "gmv", "avg_item_price")})


@query("SELECT strftime(day, '%Y%m%d')::integer AS date_key, day AS \"date\", year(day)::integer AS year, quarter(day)::integer AS quarter, month(day)::integer AS month, strftime(day, '%B') AS month_name, day(day)::integer AS day, week(day)::integer AS week_of_year, strftime(day, '%A') AS day_name, dayofweek(day) IN (0, 6) AS is_weekend FROM (SELECT unnest(generate_series(DATE '2016-01-01', DATE '2018-12-31', INTERVAL 1 DAY))::date AS day)")
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    return dims.dim_date(spark, date(2016, 1, 1), date(2018, 12, 31))


@query("SELECT p_partkey AS product_id, p_type AS category, p_size::integer AS weight_g FROM part")
def dim_product(spark: SparkSession, d: str) -> DataFrame:
    return dims.dim_product(roles.products(spark, d)).select("product_id", F.col("product_category_name_english").alias("category"), F.col("product_weight_g").alias("weight_g"))


@query("SELECT s_suppkey AS seller_id, n_name AS seller_state, lat FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, median(c_acctbal) AS lat FROM customer GROUP BY 1) ON c_nationkey = s_nationkey")
def dim_seller(spark: SparkSession, d: str) -> DataFrame:
    zips = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("zip_code_prefix")).agg(F.median("c_acctbal").alias("lat"), F.lit(0.0).alias("lng"))
    return dims.dim_seller(roles.sellers(spark, d), zips).select("seller_id", "seller_state", "lat")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return dims.dim_customer(roles.orders(spark, d), roles.customers(spark, d), roles.changes(spark, d))


@query(f"WITH {VERSIONS} SELECT customer_id, zip, city, state, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, valid_to = TIMESTAMP '9999-12-31' AS is_current, version::integer AS version FROM ver")
def dim_customer_versions(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    return v.select(F.col("customer_unique_id").alias("customer_id"), F.col("zip_code_prefix").alias("zip"), "city", "state", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"), "is_current", "version")


#: Versions with planted faults: some end a day early, some aren't current where they should be.
_FAULTY = "SELECT customer_id, valid_from, valid_to - CASE WHEN city = 'city3' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS valid_to, valid_to = TIMESTAMP '9999-12-31' AND state <> 'state2' AS is_current FROM ver"


@query(f"""WITH {VERSIONS}, f AS ({_FAULTY}), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from) AS later FROM f),
k AS (SELECT customer_id, count(*) FILTER (WHERE later <> valid_to) AS b, count(*) FILTER (WHERE is_current) AS c FROM n GROUP BY 1) SELECT coalesce(sum(b), 0)::bigint AS broken_versions, count(*) FILTER (WHERE c <> 1) AS keys_without_one_current FROM k""")
def scd2_invariants(spark: SparkSession, d: str) -> DataFrame:
    early = F.when(F.col("city") == "city3", F.col("valid_to") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to"))
    return dims.without_gaps(_versions(spark, d).withColumns({"valid_to": early, "is_current": F.col("is_current") & (F.col("state") != "state2")}))


def _fact(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(roles.items(spark, d), roles.orders(spark, d), roles.payments(spark, d), roles.customers(spark, d), roles.products(spark, d), roles.sellers(spark, d))
    return dims.fact_order_lines(lines, _versions(spark, d))


@query(f"WITH {VERSIONS}, {ITEMS} SELECT order_id, order_item_id::integer AS order_item_id, strftime(o.t0, '%Y%m%d')::integer AS date_key, v.state AS customer_state FROM items JOIN ord o USING (order_id) LEFT JOIN ver v ON v.customer_id = o.customer_id AND o.t0 >= v.valid_from AND o.t0 < v.valid_to")
def fact_with_version(spark: SparkSession, d: str) -> DataFrame:
    return _fact(spark, d).select("order_id", "order_item_id", "date_key", "customer_state")


@query(f"""WITH {VERSIONS}, {ITEMS} SELECT count(*) AS facts, count(*) FILTER (WHERE v.customer_id IS NULL OR o.t0 < v.valid_from + CASE WHEN v.city = 'BUILDING' THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END) AS invalid
FROM items JOIN ord o USING (order_id) LEFT JOIN ver v ON v.customer_id = o.customer_id AND o.t0 >= v.valid_from AND o.t0 < v.valid_to""")
def fact_versions_hold(spark: SparkSession, d: str) -> DataFrame:
    """Facts against versions of which some are taken to start thirty days later."""
    late = F.when(F.col("city") == "BUILDING", F.col("valid_from") + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("valid_from"))
    return verify.lookup_is_valid(_fact(spark, d), _versions(spark, d).withColumn("valid_from", late))


_RFM = f"""{ORDERS}, per AS (SELECT customer_id, sum(paid) AS ltv, count(DISTINCT order_id) AS n, min(t0::date) AS first, max(t0::date) AS last FROM ord WHERE order_status <> 'canceled' AND t0::date <= DATE '{AS_OF}' GROUP BY 1),
sc AS (SELECT *, date_diff('day', last, DATE '{AS_OF}') AS days, ntile(5) OVER (ORDER BY date_diff('day', last, DATE '{AS_OF}') DESC, customer_id) AS r, ntile(5) OVER (ORDER BY ltv, customer_id) AS m, CASE WHEN n >= 6 THEN 5 WHEN n >= 4 THEN 4 ELSE n END AS f, ((2 * (ltv * 100)::bigint + n) // (2 * n))::decimal(18,0) * 0.01 AS aov FROM per),
rfm AS (SELECT *, CASE WHEN r >= 4 AND f >= 2 AND m >= 4 THEN 'Champions' WHEN r >= 2 AND f >= 2 THEN 'Loyal' WHEN r >= 4 THEN 'Potential' WHEN r >= 2 AND m >= 4 THEN 'At risk' WHEN r >= 2 THEN 'Hibernating' ELSE 'Lost' END AS segment FROM sc)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    fact = roles.orders(spark, d).select(F.col("customer_id").alias("customer_unique_id"), "order_id", "order_status", F.to_date("order_purchase_timestamp").alias("order_purchase_date"), F.col("paid").alias("allocated_payment"))
    return metrics.customer_metrics(fact, F.lit(AS_OF))


@query(f"WITH {_RFM} SELECT customer_id, ltv::double AS lifetime_value, n AS order_count, first AS first_order_date, last AS last_order_date, aov::double AS avg_order_value, days::integer AS days_since_last_order, r::integer AS r_score, f::integer AS f_score, m::integer AS m_score, segment AS rfm_segment FROM rfm")
def customer_rfm(spark: SparkSession, d: str) -> DataFrame:
    out = _metrics(spark, d).withColumns({c: F.col(c).cast("double") for c in ("lifetime_value", "avg_order_value")})
    return out.withColumnRenamed("customer_unique_id", "customer_id").drop("as_of_date")


@query(f"WITH {_RFM} SELECT segment AS rfm_segment, count(*) AS customers, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::double AS pct_customers, sum(ltv)::double AS lifetime_value FROM rfm GROUP BY segment")
def kpi_segment_mix(spark: SparkSession, d: str) -> DataFrame:
    _metrics(spark, d).createOrReplaceTempView("customer_metrics")
    return spark.sql("""
        WITH latest AS (SELECT max(as_of_date) AS day FROM customer_metrics)
        SELECT rfm_segment, count(*) AS customers, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS double) AS pct_customers, CAST(sum(lifetime_value) AS double) AS lifetime_value
        FROM customer_metrics JOIN latest ON as_of_date = day GROUP BY rfm_segment""")


@query(f"WITH {_SALES} SELECT day AS order_purchase_date, category, orders, items, revenue::double AS revenue FROM daily WHERE day > (SELECT max(day) FROM daily) - INTERVAL 7 DAY")
def kpi_last_seven_days(spark: SparkSession, d: str) -> DataFrame:
    _daily(spark, d).createOrReplaceTempView("daily_sales")
    return spark.sql("""
        SELECT order_purchase_date, category, orders, items, CAST(revenue AS double) AS revenue FROM daily_sales
        WHERE order_purchase_date > (SELECT max(order_purchase_date) FROM daily_sales) - INTERVAL 7 DAYS ORDER BY order_purchase_date DESC, revenue DESC""")


@query(f"WITH {ITEMS}, {ORDERS} SELECT seller_id, n_name AS seller_state, count(DISTINCT order_id) AS orders, sum(price)::double AS revenue FROM items JOIN ord USING (order_id) JOIN supplier ON s_suppkey = seller_id JOIN nation ON n_nationkey = s_nationkey WHERE order_status NOT IN ('canceled', 'unavailable') GROUP BY ALL ORDER BY revenue DESC, seller_id LIMIT 10")
def kpi_top_sellers(spark: SparkSession, d: str) -> DataFrame:
    _sales(spark, d).createOrReplaceTempView("fact")
    roles.sellers(spark, d).createOrReplaceTempView("seller")
    return spark.sql("""
        SELECT seller_id, seller_state, count(DISTINCT order_id) AS orders, CAST(sum(price) AS double) AS revenue FROM fact JOIN seller USING (seller_id)
        WHERE order_status NOT IN ('canceled', 'unavailable') GROUP BY seller_id, seller_state ORDER BY revenue DESC, seller_id LIMIT 10""")


@query(f"WITH {VERSIONS}, n AS (SELECT state, lead(state) OVER (PARTITION BY customer_id ORDER BY version) AS later FROM ver) SELECT state AS from_state, later AS to_state, count(*) AS moves FROM n WHERE later IS NOT NULL AND later <> state GROUP BY ALL ORDER BY moves DESC, from_state, to_state LIMIT 10")
def kpi_state_moves(spark: SparkSession, d: str) -> DataFrame:
    _versions(spark, d).createOrReplaceTempView("customer_versions")
    return spark.sql("""
        WITH n AS (SELECT state, lead(state) OVER (PARTITION BY customer_unique_id ORDER BY version) AS later FROM customer_versions)
        SELECT state AS from_state, later AS to_state, count(*) AS moves FROM n WHERE later IS NOT NULL AND later <> state
        GROUP BY state, later ORDER BY moves DESC, from_state, to_state LIMIT 10""")


@query(f"WITH {ORDERS} SELECT strftime(t0, '%Y-%m') AS month, count(*) AS orders, sum(paid)::double AS revenue FROM ord WHERE order_status <> 'canceled' GROUP BY 1")
def monthly_revenue(spark: SparkSession, d: str) -> DataFrame:
    o = roles.orders(spark, d).where("order_status != 'canceled'")
    return o.groupBy(F.date_format("order_purchase_timestamp", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"), F.sum("paid").cast("double").alias("revenue"))


@query("SELECT n_name AS state, sum(o_totalprice::decimal(12,2))::double AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-04-01' GROUP BY 1 ORDER BY revenue DESC, state LIMIT 5")
def month_revenue_by_state(spark: SparkSession, d: str) -> DataFrame:
    o = roles.orders(spark, d).where((F.col("order_purchase_timestamp") >= F.lit(date(1996, 3, 1))) & (F.col("order_purchase_timestamp") < F.lit(date(1996, 4, 1))))
    found = joins.lookup(o, roles.customers(spark, d), ["customer_id"], "inner").groupBy(F.col("customer_state").alias("state")).agg(F.sum("paid").cast("double").alias("revenue"))
    return found.orderBy(F.desc("revenue"), "state").limit(5)


@query(f"WITH {ORDERS} SELECT n_name AS state, count(*) AS delivered, count(*) FILTER (WHERE date_diff('day', promised::date, delivered::date) > 0) AS late, avg(date_diff('day', promised::date, delivered::date))::double AS mean_days FROM ord JOIN customer ON c_custkey = customer_id JOIN nation ON n_nationkey = c_nationkey WHERE delivered IS NOT NULL GROUP BY 1")
def late_delivery_by_state(spark: SparkSession, d: str) -> DataFrame:
    o = roles.orders(spark, d).where("order_delivered_customer_date IS NOT NULL").withColumn("days", lateness_days(F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")))
    found = joins.lookup(o, roles.customers(spark, d), ["customer_id"], "inner")
    return found.groupBy(F.col("customer_state").alias("state")).agg(F.count("*").alias("delivered"), F.count_if(F.col("days") > 0).alias("late"), F.avg("days").alias("mean_days"))


@query("SELECT least(n, 5)::bigint AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def repeat_customers(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy(F.least("n", F.lit(5)).cast("long").alias("orders")).agg(F.count("*").alias("customers"))


@query(f"WITH {_SALES} SELECT category, sum(revenue)::double AS revenue FROM daily GROUP BY 1 ORDER BY revenue DESC, category LIMIT 3")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    per = _daily(spark, d).groupBy("category").agg(F.sum("revenue").cast("double").alias("revenue"))
    return per.orderBy(F.desc("revenue"), "category").limit(3)


@query(f"WITH {ITEMS}, {ORDERS} SELECT order_status, count(*) AS items, sum(price)::double AS revenue, min(t0)::date AS first, max(t0)::date AS last FROM items JOIN ord USING (order_id) GROUP BY 1")
def answers_by_status(spark: SparkSession, d: str) -> DataFrame:
    return _sales(spark, d).groupBy("order_status").agg(F.count("*").alias("items"), F.sum("price").cast("double").alias("revenue"), F.min("order_purchase_date").alias("first"), F.max("order_purchase_date").alias("last"))


@query("""SELECT k AS o_orderkey, coalesce(l, 0)::double AS lines, coalesce(w, 0)::double AS whole FROM (SELECT coalesce(l_orderkey, o_orderkey) AS k, l, w
FROM (SELECT l_orderkey, sum(l_extendedprice::decimal(12,2)) AS l FROM lineitem GROUP BY 1) FULL JOIN (SELECT o_orderkey, o_totalprice::decimal(12,2) AS w FROM orders) ON l_orderkey = o_orderkey) WHERE coalesce(l, 0) <> coalesce(w, 0)""")
def sums_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose total isn't the sum of their lines."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(12,2)").alias("v"))
    wholes = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(22,2)").alias("v"))
    amount = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return verify.sums_agree(parts, wholes, "o_orderkey", "v", "v").select("o_orderkey", amount("left_value").alias("lines"), amount("right_value").alias("whole"))
