"""Scans, keys, cleaning, joins, aggregates, windows, replay and upserts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blank_to_null, lenient_int, normalize_state, parse_first, surrogate_key
from ..functions.clean import ISO_TIME, LOCAL_TIME
from ..operators import aggregates, cleaning, joins, keys, orders, replay, routing, verify
from ..sources.files import address_pool
from ..sources.jdbc import Window, windowed
from . import roles
from .registry import query
from .roles import CHANGES, ITEMS, ORDERS, table

D = lambda *x: F.lit(date(*x))


@query("SELECT o_orderkey, o_orderdate::date AS day FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-31 23:59:59' AND o_orderdate <= TIMESTAMP '1996-02-29 23:59:59'")
def incremental_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window(datetime(1996, 2, 29, 23, 59, 59), datetime(1996, 1, 31, 23, 59, 59))
    return windowed(table(spark, d, "orders"), w, "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT event_id, ts::date AS day FROM events WHERE ts::date = (SELECT max(ts::date) FROM events WHERE ts::date <= DATE '2024-01-20')")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day")).where(F.col("day") <= D(2024, 1, 20))
    e.createOrReplaceTempView("snapshot_days")
    return spark.sql("SELECT event_id, day FROM snapshot_days WHERE day = (SELECT max(day) FROM snapshot_days)")


@query("SELECT user_id, min(ts::date) AS first_day FROM events GROUP BY user_id HAVING min(ts::date) <= DATE '2024-01-03'")
def as_of_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("first_day"))
    return e.where(F.col("first_day") <= D(2024, 1, 3))


@query(f"WITH {ITEMS} SELECT order_id, order_item_id::integer AS order_item_id, product_id, seller_id, l_shipdate::date AS shipped FROM items")
def latest_line_version(spark: SparkSession, d: str) -> DataFrame:
    return roles.items(spark, d).select("order_id", "order_item_id", "product_id", "seller_id", F.to_date("l_shipdate").alias("shipped"))


@query('SELECT sum(n)::bigint AS "rows", count(*) AS unique_keys, sum(n - 1)::bigint AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)')
def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return keys.duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_order_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return keys.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE rn = 1")
def mode_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return keys.mode_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT o_orderkey, min(o_orderdate::date) OVER (PARTITION BY o_custkey) AS first_day FROM orders")
def first_seen_day(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("first_day"))
    return keys.first_seen(o, ["o_custkey"], "first_day").select("o_orderkey", "first_day")


_DIRT = ["' sp '", "'São Paulo'", "'rio de janeiro'", "'MINAS GERAIS'", "'XX'", "NULL", "'Paraná'", "'  '"]


@query(f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'SP' WHEN 1 THEN 'SP' WHEN 2 THEN 'RJ' WHEN 3 THEN 'MG' WHEN 6 THEN 'PR' END AS state, nullif(trim([{', '.join(_DIRT)}][event_id % 8 + 1]), '') AS filled FROM events")
def normalized_states(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.expr(f"array({', '.join(_DIRT)})"), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", normalize_state(raw).alias("state"), blank_to_null(raw).alias("filled"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::bigint END AS seen FROM events")
def two_time_formats(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "yesterday").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(parse_first(raw, ISO_TIME, LOCAL_TIME)).alias("seen"))


@query("SELECT event_id, [2, NULL, 2, 0, NULL, NULL, -7, NULL][event_id % 8 + 1]::integer AS n FROM events")
def lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["2", "two", "2.5", ".5", "1e2", "2147483648", " -7 ", ""])), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", lenient_int(raw).alias("n"))


_RULES = "CASE WHEN event_id % 50 = 0 THEN 'missing_required_field' WHEN value < 5 THEN 'small_value' WHEN c_custkey IS NULL THEN 'unknown_customer' END"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    e = joins.with_exists(table(spark, d, "events"), known, ["user_id"])
    return routing.tag(e, [("missing_required_field", F.col("event_id") % 50 == 0), ("small_value", F.col("value") < 5), ("unknown_customer", ~F.col("_known"))])


@query(f"SELECT coalesce({_RULES}, 'valid') AS reason, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
def quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).groupBy(F.coalesce(routing.REASON, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, user_id FROM events LEFT JOIN customer ON c_custkey = user_id WHERE {_RULES} IS NULL")
def quarantine_valid(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).where(F.col(routing.REASON).isNull()).select("event_id", "user_id")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_shipdate::date AS seen, CASE WHEN l_orderkey % 9 = 0 THEN 'orphan_order' WHEN l_quantity < 2 THEN 'small' END AS reason FROM lineitem),
s AS (SELECT *, CASE WHEN reason IS NULL THEN 'valid' WHEN reason = 'orphan_order' AND date_diff('day', seen, DATE '1998-01-01') < 7 THEN 'pending' ELSE 'quarantined' END AS status FROM t),
p AS (SELECT status, count(*) AS n FROM s GROUP BY status, l_orderkey, l_linenumber)
SELECT sum(n)::bigint AS rows_in, count(*) FILTER (WHERE status = 'valid') AS rows_valid, (coalesce(sum(n - 1) FILTER (WHERE status = 'valid'), 0))::bigint AS rows_duplicate, coalesce(sum(n) FILTER (WHERE status = 'quarantined'), 0)::bigint AS rows_quarantined, coalesce(sum(n) FILTER (WHERE status = 'pending'), 0)::bigint AS rows_pending FROM p""")
def row_accounting(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    reason = routing.first_failure([("orphan_order", F.col("l_orderkey") % 9 == 0), ("small", F.col("l_quantity") < 2)])
    s = t.withColumn("status", routing.late_status(reason, F.to_date("l_shipdate"), D(1998, 1, 1)))
    return routing.accounting(s, "status", ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber::integer AS l_linenumber, l_shipdate::date AS seen FROM lineitem WHERE l_orderkey % 9 = 0 AND date_diff('day', l_shipdate::date, DATE '1998-01-01') < 7")
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    status = routing.late_status(F.when(F.col("l_orderkey") % 9 == 0, "orphan_order"), F.to_date("l_shipdate"), D(1998, 1, 1))
    return t.where(status == "pending").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("seen"))


@query("SELECT count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("value") > 50).alias("high"), (F.col("event_type") == "error").alias("errors"))
    return routing.flag_counts(e, ["high", "errors"])


@query("""WITH r AS (SELECT c_nationkey::varchar AS zip, c_acctbal AS lat, c_custkey::double AS lng, c_mktsegment AS city, n_name AS state FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT zip, city, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city) AS rn FROM r GROUP BY zip, city)
SELECT zip AS zip_code_prefix, median(lat) AS lat, median(lng) AS lng, any_value(m.city) AS city, any_value(state) AS state, count(*) AS source_rows FROM r JOIN m USING (zip) WHERE rn = 1 GROUP BY zip""")
def geolocation(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    raw = joins.lookup(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, ["n_nationkey"], "inner").select(
        F.col("n_nationkey").cast("string").alias("geolocation_zip_code_prefix"), F.col("c_acctbal").alias("geolocation_lat"), F.col("c_custkey").cast("double").alias("geolocation_lng"), F.col("c_mktsegment").alias("geolocation_city"), F.col("n_name").alias("geolocation_state"))
    return cleaning.build_geolocation(raw)


@query("SELECT DISTINCT c_nationkey AS zip, c_mktsegment AS city, n_name AS state FROM customer JOIN nation ON n_nationkey = c_nationkey")
def address_pool_rows(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    raw = joins.lookup(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, ["n_nationkey"], "inner").select(F.col("n_nationkey").alias("geolocation_zip_code_prefix"), F.col("c_mktsegment").alias("geolocation_city"), F.col("n_name").alias("geolocation_state"))
    return address_pool(raw).toDF("zip", "city", "state")


@query("SELECT p_partkey AS product_id, coalesce(CASE WHEN p_size % 7 <> 0 THEN p_type END, 'unknown') AS product_category_name, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_type LIKE '%A%' THEN 'english ' || p_type ELSE 'unknown' END AS product_category_name_english FROM part")
def translated_products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = p.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("product_category_name"), *[F.lit(None).cast("int").alias(c) for c in ("product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")])
    words = p.where(F.col("p_type").like("%A%")).select(F.col("p_type").alias("product_category_name"), F.concat(F.lit("english "), "p_type").alias("product_category_name_english")).distinct()
    return cleaning.build_products(raw, words).select("product_id", "product_category_name", "product_category_name_english")


@query("SELECT l_orderkey AS order_id, sum(l_extendedprice::decimal(10,2))::double AS payment_total, count(*) AS payment_count, max_by(l_returnflag, (l_extendedprice::decimal(10,2), l_returnflag)) AS payment_type_main, max(l_linenumber)::integer AS payment_installments_max FROM lineitem GROUP BY l_orderkey")
def payments_per_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("payment_type"), F.col("l_linenumber").cast("int").alias("payment_installments"), F.col("l_extendedprice").cast("decimal(10,2)").alias("payment_value"))
    return aggregates.payments_per_order(p).withColumn("payment_total", F.col("payment_total").cast("double"))


_ALLOCATED = f"""WITH {ITEMS}, l AS (SELECT order_id, order_item_id, (price + freight_value)::decimal(12,2) AS t, o_totalprice::decimal(10,2)::decimal(20,2) AS paid FROM items JOIN orders ON o_orderkey = order_id),
s AS (SELECT *, sum(t) OVER (PARTITION BY order_id) AS whole, count(*) OVER (PARTITION BY order_id) AS n, row_number() OVER (PARTITION BY order_id ORDER BY order_item_id DESC) AS rn FROM l),
p AS (SELECT *, round(paid::double * CASE WHEN whole > 0 THEN t / whole ELSE 1.0 / n END, 2)::decimal(12,2) AS part FROM s),
a AS (SELECT order_id, order_item_id, paid, CASE WHEN rn = 1 THEN paid - coalesce(sum(CASE WHEN rn > 1 THEN part END) OVER (PARTITION BY order_id), 0) ELSE part END AS got FROM p)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return orders.order_lines(roles.items(spark, d), roles.orders(spark, d), roles.payments(spark, d), roles.customers(spark, d), roles.products(spark, d), roles.sellers(spark, d))


@query(f"{_ALLOCATED} SELECT order_id, order_item_id::integer AS order_item_id, got::double AS allocated_payment FROM a")
def payment_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("order_id", "order_item_id", F.col("allocated_payment").cast("double").alias("allocated_payment"))


@query(f"{_ALLOCATED} SELECT order_id FROM a GROUP BY order_id HAVING sum(got) <> any_value(paid)")
def allocation_gaps(spark: SparkSession, d: str) -> DataFrame:
    return verify.allocation_gaps(_lines(spark, d)).select("order_id")


@query(f"""WITH {ITEMS}, {ORDERS} SELECT order_id, order_item_id::integer AS order_item_id, order_status, t0::date AS day, (price + freight_value)::double AS line_total, p_type AS category, n_name AS customer_state, s_name AS seller
FROM items JOIN ord USING (order_id) LEFT JOIN customer ON c_custkey = customer_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN part ON p_partkey = product_id LEFT JOIN supplier ON s_suppkey = seller_id""")
def order_lines_wide(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    names = roles.sellers(spark, d).select("seller_id", F.col("seller_city").alias("seller"))
    return joins.lookup(lines, names, ["seller_id"]).select("order_id", "order_item_id", "order_status", F.col("order_purchase_date").alias("day"), F.col("line_total").cast("double").alias("line_total"), F.col("product_category_name_english").alias("category"), "customer_state", "seller")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark: SparkSession, d: str) -> DataFrame:
    return orders.without_lines(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey")


@query("SELECT event_id, c_custkey IS NOT NULL AS known FROM events LEFT JOIN customer ON c_custkey = user_id")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return joins.with_exists(table(spark, d, "events"), known, ["user_id"], "known").select("event_id", "known")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY ALL")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.orphans(table(spark, d, "lineitem"), good, ["l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_extendedprice::decimal(12,2))::double AS total FROM lineitem GROUP BY 1")
def salted_sum(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice").cast("decimal(12,2)"))
    return aggregates.salted_sum(t, ["l_returnflag"], "v", 8, ["l_orderkey", "l_linenumber"]).withColumn("total", F.col("total").cast("double"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_extendedprice::decimal(12,2))::double AS total FROM lineitem GROUP BY 1")
def plain_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("total"))


@query("SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name")
def salted_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return joins.salted_join(table(spark, d, "lineitem"), s, ["l_suppkey"], 8, ["l_orderkey", "l_linenumber"]).groupBy("s_name").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, copy::integer AS copy FROM nation, range(0, 4) r(copy)")
def replicated_rows(spark: SparkSession, d: str) -> DataFrame:
    return joins.replicate(table(spark, d, "nation"), 4).select("n_nationkey", "copy")


@query("SELECT p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their parts, joined by the keys that each side makes for itself."""
    part = table(spark, d, "part").select(surrogate_key("product", "p_partkey").alias("product_sk"), "p_type")
    return table(spark, d, "lineitem").select(surrogate_key("product", "l_partkey").alias("product_sk")).join(part, "product_sk").groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"""WITH {ORDERS} SELECT order_id, CASE WHEN approved::date <= DATE '1998-01-10' THEN approved::date END AS approved, CASE WHEN carrier::date <= DATE '1998-01-10' THEN carrier::date END AS carrier, CASE WHEN delivered::date <= DATE '1998-01-10' THEN delivered::date END AS delivered,
CASE WHEN greatest(approved::date > DATE '1998-01-10', carrier::date > DATE '1998-01-10', coalesce(delivered::date > DATE '1998-01-10', false)) THEN CASE WHEN delivered::date <= DATE '1998-01-10' THEN 'delivered' WHEN carrier::date <= DATE '1998-01-10' THEN 'shipped' WHEN approved::date <= DATE '1998-01-10' THEN 'approved' ELSE 'created' END ELSE order_status END AS status
FROM ord WHERE t0::date <= DATE '1998-01-10'""")
def orders_as_of(spark: SparkSession, d: str) -> DataFrame:
    found = replay.order_as_of(roles.orders(spark, d), D(1998, 1, 10))
    return found.select("order_id", F.to_date("order_approved_at").alias("approved"), F.to_date("order_delivered_carrier_date").alias("carrier"), F.to_date("order_delivered_customer_date").alias("delivered"), F.col("order_status").alias("status"))


@query(f"WITH {ORDERS} SELECT DISTINCT order_id, day FROM (SELECT order_id, unnest([t0::date, greatest(t0::date, approved::date), greatest(t0::date, carrier::date), greatest(t0::date, coalesce(delivered::date, t0::date))]) AS day FROM ord)")
def change_days(spark: SparkSession, d: str) -> DataFrame:
    return replay.change_days(roles.orders(spark, d))


@query(f"WITH {ORDERS} SELECT day, coalesce(string_agg(order_id::varchar, ',' ORDER BY order_id::varchar) FILTER (WHERE day = t0), '') AS purchased, coalesce(string_agg(order_id::varchar, ',' ORDER BY order_id::varchar) FILTER (WHERE day <> t0), '') AS changed FROM (SELECT DISTINCT order_id, t0::date AS t0, unnest([t0::date, approved::date, carrier::date, coalesce(delivered::date, t0::date)]) AS day FROM ord) GROUP BY day")
def daily_index(spark: SparkSession, d: str) -> DataFrame:
    o = roles.orders(spark, d).withColumn("order_id", F.col("order_id").cast("string"))
    return replay.daily_index(o).select("day", F.array_join("purchased", ",").alias("purchased"), F.array_join("changed", ",").alias("changed"))


@query("SELECT o_custkey AS customer_id, min(o_orderdate::date) AS first_day FROM orders GROUP BY 1 HAVING min(o_orderdate::date) <= DATE '1995-06-30'")
def known_customers(spark: SparkSession, d: str) -> DataFrame:
    return replay.known_customers(roles.orders(spark, d), D(1995, 6, 30), "customer_id")


_HALVES = "old AS (SELECT o_orderkey AS k, 1 AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS s FROM orders WHERE o_orderkey % 3 <> 1)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = o.where(k % 3 != 0).select(k.alias("k"), F.lit(1).alias("v"), F.col("o_orderstatus").alias("s"))
    return old, o.where(k % 3 != 1).select(k.alias("k"), F.when(k % 5 == 0, 0).otherwise(2).alias("v"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("X").alias("s"))


@query(f"WITH {_HALVES} SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL OR (new.v > old.v AND new.s IS DISTINCT FROM old.s) THEN new.v ELSE old.v END AS v, CASE WHEN old.k IS NULL OR (new.v > old.v AND new.s IS DISTINCT FROM old.s) THEN new.s ELSE old.s END AS s FROM old FULL JOIN new ON old.k = new.k")
def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    return replay.guarded_upsert(*_halves(spark, d), ["k"], "v")


@query(f"WITH {_HALVES} SELECT k, v, s FROM old UNION ALL SELECT k, v, s FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    return replay.insert_if_absent(*_halves(spark, d), ["k"])


@query(f"WITH {_HALVES}, u AS (SELECT *, DATE '2024-01-01' AS b FROM old UNION ALL SELECT *, DATE '2024-01-02' FROM new) SELECT k, v, s, min_b AS first_day FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, b DESC) AS rn, min(b) OVER (PARTITION BY k) AS min_b FROM u) WHERE rn = 1")
def merge_latest(spark: SparkSession, d: str) -> DataFrame:
    old, new = (cleaning.add_row_metadata(x, D(2024, 1, i), F.lit(datetime(2024, 1, i))) for i, x in enumerate(_halves(spark, d), 1))
    return cleaning.merge_versions(new, old, ["k"], [F.desc("v"), F.desc("_batch_date")]).select("k", "v", "s", F.col("_first_batch_date").alias("first_day"))


@query(f"WITH {_HALVES} SELECT k, CASE WHEN new.k IS NULL THEN 'missing' WHEN old.k IS NULL THEN 'extra' ELSE 'different' END AS kind FROM old FULL JOIN new USING (k) WHERE new.k IS NULL OR old.k IS NULL OR old.v <> new.v OR old.s <> new.s")
def keyed_diff(spark: SparkSession, d: str) -> DataFrame:
    return verify.keyed_diff(*_halves(spark, d), ["k"])


@query("SELECT day, sum(x)::bigint AS surplus FROM (SELECT o_orderdate::date AS day, 1 AS x FROM orders UNION ALL SELECT l_shipdate::date, -1 FROM lineitem) GROUP BY 1 HAVING sum(x) <> 0")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """Days of all orders against days of all order lines."""
    day = lambda t, c: table(spark, d, t).select(F.to_date(c).alias("day"))
    return verify.multiset_difference(day("orders", "o_orderdate"), day("lineitem", "l_shipdate"))


@query("SELECT o_orderstatus, o_orderpriority FROM (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 1)")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    names = ["o_orderstatus", "o_orderpriority"]
    return o.where(k % 2 == 0).select(*names).exceptAll(o.where(k % 2 == 1).select(*names))


@query("SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS left_value, b.n AS right_value, a.n IS NOT DISTINCT FROM b.n AS agrees FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def full_outer_compare(spark: SparkSession, d: str) -> DataFrame:
    n = lambda r: table(spark, d, "orders").where(F.col("o_orderkey") % 2 == r).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.compare_outer(n(0), n(1), ["o_custkey"], "n")


_DIGEST = "coalesce(sum(('0x' || substr(h, {}, 15))::bigint), 0)::varchar"


@query(f"""WITH r AS (SELECT md5(concat_ws(chr(31), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate::date)) AS h FROM lineitem)
SELECT md5(concat_ws('-', {_DIGEST.format(1)}, {_DIGEST.format(17)}, count(*)::varchar)) AS content_md5, count(*) AS "rows" FROM r""")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]
    return aggregates.content_hash(table(spark, d, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate")), names)


@query("SELECT o_orderkey, greatest(o_orderdate::date, DATE '1995-01-01') AS day FROM orders")
def review_release_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", replay.review_release_day(F.lit(datetime(1995, 1, 1, 9)), F.col("o_orderdate")).alias("day"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL OR NOT json_valid(props) AS broken FROM events")
def corrupt_split(spark: SparkSession, d: str) -> DataFrame:
    """Texts that can't be read as JSON go their own way, whole."""
    e = table(spark, d, "events").withColumn("r", F.from_json("props", "k string, _corrupt_record string", {"mode": "PERMISSIVE"}))
    good, bad = routing.split_corrupt(e.select("event_id", "props", "r.k", F.when(F.col("r").isNull(), "").otherwise(F.col("r._corrupt_record")).alias("_corrupt_record")))
    return good.select("event_id", "k", F.lit(False).alias("broken")).unionByName(bad.select("event_id", F.lit(None).cast("string").alias("k"), F.lit(True).alias("broken")))


@query("SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal, c_custkey)::integer AS tile FROM customer")
def global_quintiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.global_ntile(table(spark, d, "customer"), [F.col("c_acctbal"), F.col("c_custkey")], "tile").select("c_custkey", "tile")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::double AS pct FROM events GROUP BY 1")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.share_of_total(table(spark, d, "events"), ["event_type"]).withColumn("pct", F.col("pct").cast("double"))


@query("SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, ts::date AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT day FROM (SELECT o_orderdate::date AS day FROM orders UNION ALL SELECT l_shipdate::date FROM lineitem) WHERE day IS NOT NULL")
def affected_days(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both tables as changed, as in a first load."""
    day = lambda t, c: table(spark, d, t).select(F.to_date(c).alias("day"))
    return orders.affected_days([day("orders", "o_orderdate"), day("lineitem", "l_shipdate")], "day")


@query(f"WITH {CHANGES} SELECT change_id, customer_id, t0::date AS day FROM chg")
def change_requests(spark: SparkSession, d: str) -> DataFrame:
    return roles.changes(spark, d).select("change_id", F.col("customer_unique_id").alias("customer_id"), F.to_date("requested_at").alias("day"))
