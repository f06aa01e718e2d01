from datetime import date, datetime
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tidelake.jobs.bronze import BronzeJob
from tidelake.jobs.gold import GoldJob
from tidelake.jobs.ledger import IngestRange, Ledger, LayerRun
from tidelake.jobs.quality import run_layer
from tidelake.jobs.silver import SilverJob, TableJob, customer_activity_job, customer_changes_job
from tidelake.operators.cleaning import tag_order_children, tag_orders
from tidelake.operators.verify import lake_snapshot
from tidelake.sources.files import land_lines
from tidelake.sources.jdbc import Window, windowed
from tidelake.sources.lake import Lake

D1, D2, D3 = date(2017, 3, 1), date(2017, 3, 2), date(2017, 3, 3)


def end(day):
    return datetime(day.year, day.month, day.day, 23, 59, 59)


def test_ledger_windows(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger.json"))
    assert ledger.window("pg", "orders", end(D1)) == Window(end(D1))
    ledger.record_ingest("pg", "orders", Window(end(D1)), 3)
    ledger.record_ingest("pg", "orders", Window(end(D3), end(D1)), 1)  # a gap
    assert ledger.window("pg", "orders", end(D2)) == Window(end(D2), end(D1))
    ledger.record_ingest("pg", "orders", ledger.window("pg", "orders", end(D2)), 1)
    assert ledger.marks["pg.orders"].startswith("2017-03-03")  # never back
    assert ledger.window("pg", "orders", end(D3)).low == end(D2)
    assert ledger.range("silver", "t", D2) == IngestRange(D2)
    ledger.record("silver", "t", D1, IngestRange(D1), LayerRun(3, 1, 1, 1, 1, 0))
    assert ledger.range("silver", "t", D2) == IngestRange(D2, D1) and ledger.range("silver", "t", D2, True) == IngestRange(D2)
    with pytest.raises(ValueError, match="balance"):
        ledger.record("silver", "t", D1, IngestRange(D1), LayerRun(3, 1))
    again = Ledger(spark, str(tmp_path / "ledger.json"))
    assert again.dump() == ledger.dump()
    other = Ledger()
    assert other.absorb(ledger.export(D2)) == (2, 0) and other.last_run("silver", "t", D2) == D1


def sources(spark):
    o = [("o1", "c1", D1, D1), ("o2", "c1", D2, D2), ("o2", "c1", D2, D3), ("o3", "c1", D3, D3)]
    orders = spark.createDataFrame([(i, c, "created", end(d), end(u)) for i, c, d, u in o], "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, updated_at timestamp")
    items = spark.createDataFrame([("o1", 1, Dec("9.00"), end(D1)), ("o3", 1, Dec("5.00"), end(D2)), ("o9", 1, Dec("1.00"), end(D1))], "order_id string, order_item_id int, price decimal(10,2), updated_at timestamp")
    return orders, items


def run_day(spark, lake, ledger, day, again=False):
    orders, items = sources(spark)
    bronze = BronzeJob(lake, ledger, day)
    for name, df in (("orders", orders), ("order_items", items)):
        bronze.incremental("pg", name, lambda w, df=df: windowed(df, w))
    customers = spark.createDataFrame([("c1",)], "customer_id string")
    job = SilverJob(lake, ledger, day)
    out = {"orders": job.process(TableJob("orders", "pg", ["order_id"], [F.desc("updated_at")], lambda df: tag_orders(df, customers), "order_purchase_date"))}
    known = lake.as_of(lake.path("silver", "orders"), day)
    out["order_items"] = job.process(TableJob("order_items", "pg", ["order_id", "order_item_id"], [F.desc("updated_at")], lambda df: tag_order_children(df, known, ["order_id", "order_item_id"]), "order_purchase_date"))
    return out


def state(lake):
    return sorted(map(tuple, lake_snapshot({t: lake.read(lake.path("silver", t)) for t in ("orders", "order_items")}).collect()))


def test_late_rows_wait_and_reruns_change_nothing(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()
    assert run_day(spark, lake, ledger, D1)["order_items"] == LayerRun(2, 1, 0, 0, 1, 1, "pending: 0 retried, 1 still waiting")
    second = run_day(spark, lake, ledger, D2)["order_items"]
    assert (second.rows_in, second.rows_pending, second.rows_valid) == (2, 2, 0)
    before = state(lake)
    assert run_day(spark, lake, ledger, D2)["order_items"] == second and state(lake) == before
    third = run_day(spark, lake, ledger, D3)
    assert (third["order_items"].rows_valid, third["order_items"].rows_pending) == (1, 1)
    assert sorted(r.order_id for r in lake.read(lake.path("silver", "order_items")).collect()) == ["o1", "o3"]
    assert {r.order_id: r._first_batch_date for r in lake.read(lake.path("silver", "orders")).collect()} == {"o1": D1, "o2": D2, "o3": D3}
    late = SilverJob(lake, ledger, date(2017, 3, 20)).process(TableJob("order_items", "pg", ["order_id", "order_item_id"], [F.desc("updated_at")], lambda df: tag_order_children(df, lake.read(lake.path("silver", "orders")), ["order_id"]), "order_purchase_date"))
    assert (late.rows_quarantined, late.rows_pending) == (1, 0)
    reasons = lake.read(lake.path("silver", "_quarantine", "order_items")).collect()
    assert [(r.order_id, r._reason) for r in reasons] == [("o9", "orphan_order")]


def test_reference_snapshots_and_files(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()
    df = spark.createDataFrame([("p1", 1)], "product_id string, n int")
    assert BronzeJob(lake, ledger, D1).reference("pg", "products", lambda: df) == 1
    assert BronzeJob(lake, ledger, D2).reference("pg", "products", lambda: df) is None
    assert BronzeJob(lake, ledger, D3).reference("pg", "products", lambda: df.withColumn("n", F.lit(2))) == 1
    folder = str(tmp_path / "landing")
    land_lines(folder, "a.jsonl", [{"change_id": "c1"}])
    assert BronzeJob(lake, ledger, D1).lines(folder) == 1


def test_gold_and_its_quality(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()

    def put(name, rows, ddl):
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(lake.path("silver", name))

    put("products", [("p1", "x", "toys", 1, 1, 1, 1, 1)], "product_id string, product_category_name string, product_category_name_english string, " + ", ".join(f"product_{c} int" for c in ("weight_g", "length_cm", "height_cm", "width_cm", "photos_qty")))
    put("sellers", [("s1", "1", "sp", "SP")], "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string")
    put("geolocation", [("1", -23.0, -46.0)], "zip_code_prefix string, lat double, lng double")
    put("customers", [("c1", "u1", "1", "sp", "SP")], "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string")
    put("orders", [("o1", "c1", datetime(2017, 3, 1, 10))], "order_id string, customer_id string, order_purchase_timestamp timestamp")
    put("order_lines", [("o1", i, "p1", "s1", "u1", "delivered", datetime(2017, 3, 1, 10), D1, "SP", "card", 1, Dec("10.00"), Dec("1.00"), Dec("11.00"), Dec("11.00"), D2) for i in (1, 2)], "order_id string, order_item_id int, product_id string, seller_id string, customer_unique_id string, order_status string, order_purchase_timestamp timestamp, order_purchase_date date, customer_state string, payment_type_main string, payment_installments_max int, price decimal(10,2), freight_value decimal(10,2), line_total decimal(12,2), allocated_payment decimal(12,2), _batch_date date")
    names = ["dim_date", "dim_product", "dim_seller", "dim_customer", "fact_order_lines", "agg_daily_category_sales", "customer_metrics"]
    snap = lambda: sorted(map(tuple, lake_snapshot({n: lake.read(lake.path("gold", n)) for n in names}).collect()))
    GoldJob(lake, ledger, D2).run()
    before = snap()
    GoldJob(lake, ledger, D2).run()
    assert snap() == before and lake.read(lake.path("gold", "agg_daily_category_sales")).first().items == 2
    results = run_layer(lake, ledger, "gold", D2)
    assert [(r.table, r.check, r.detail) for r in results if r.blocking] == [] and len(results) == 31
    assert ledger.previous_observed("gold.customer_metrics", "row_count_vs_previous", D3) == 1.0


def test_streaming(spark, tmp_path):
    from tidelake import streaming

    src, out = str(tmp_path / "in"), []
    ddl = "id long, ts timestamp, kind string"
    spark.createDataFrame([(i % 3, datetime(2024, 1, 1 + i), "a") for i in range(9)], ddl).write.parquet(src)
    events = streaming.stream_parquet(spark, src, ddl)
    streaming.run_available(streaming.daily_counts(events, "ts", ["kind"], "1 day"), lambda df, _: out.extend(df.collect()), str(tmp_path / "c1"))
    assert {(r.day, r.n) for r in out} >= {(date(2024, 1, 1), 1), (date(2024, 1, 5), 1)}
    seen: list = []
    streaming.run_available(streaming.deduplicated(events, "ts", ["id"], "30 days"), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c2"))
    assert sorted(r.id for r in seen) == [0, 1, 2]
    merged: list = []
    streaming.merge_stream(events, lambda df: merged.append(df.count()), str(tmp_path / "c3"))
    streaming.merge_stream(events, lambda df: merged.append(df.count()), str(tmp_path / "c3"))
    assert sum(merged) == 9


def test_reference_tables_and_order_lines(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()
    sellers = spark.createDataFrame([("s1", "1", "sp", "SP")], "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string")
    BronzeJob(lake, ledger, D1).reference("pg", "sellers", lambda: sellers)
    build = lambda df: df.drop("ingest_date", "_ingested_at", "_batch_date", "_source")
    assert SilverJob(lake, ledger, D1).reference("sellers", "pg", ["seller_id"], build).rows_written == 1
    assert SilverJob(lake, ledger, D2).reference("sellers", "pg", ["seller_id"], build) is None

    def put(name, rows, ddl, day="order_purchase_date"):
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(lake.path("silver", name))

    put("products", [("p1", "brinquedos", "toys")], "product_id string, product_category_name string, product_category_name_english string")
    put("customers", [("c1", "u1", "1", "sp", "SP")], "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string")
    put("orders", [(f"o{d.day}", "c1", "delivered", end(d), end(d), None, None, end(d), d, d) for d in (D1, D2)], "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, order_approved_at timestamp, order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp, order_purchase_date date, _batch_date date")
    put("order_items", [(f"o{d.day}", 1, "p1", "s1", end(d), Dec("9.00"), Dec("1.00"), d, d) for d in (D1, D2)], "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date timestamp, price decimal(10,2), freight_value decimal(10,2), order_purchase_date date, _batch_date date")
    put("order_payments", [(f"o{d.day}", 1, "card", 1, Dec("10.00"), d, d) for d in (D1, D2)], "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(10,2), order_purchase_date date, _batch_date date")
    assert SilverJob(lake, ledger, D1, full_refresh=True).order_lines().rows_written == 2
    assert SilverJob(lake, ledger, D2).order_lines().rows_written == 1  # only the day that it touches
    assert SilverJob(lake, ledger, D3).order_lines().rows_written == 0
    lines = {r.order_id: r for r in lake.read(lake.path("silver", "order_lines")).collect()}
    assert sorted(lines) == ["o1", "o2"] and lines["o1"].allocated_payment == Dec("10.00")
    assert lines["o1"].product_category_name == "brinquedos" and lines["o1"].seller_city == "sp" and lines["o1"].order_approved_at == end(D1)
    assert SilverJob(Lake(spark, str(tmp_path / "other")), Ledger(), D1).order_lines().detail.startswith("not there yet")


def test_a_reference_is_rebuilt_when_either_source_changes_or_it_is_gone(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()
    put = lambda day, table, rows, ddl: BronzeJob(lake, ledger, day).reference("pg", table, lambda: spark.createDataFrame(rows, ddl))
    build = lambda a, b: a.join(b.select("w", "n"), "w").select("k", "w", "n")
    run = lambda day: SilverJob(lake, ledger, day).reference("products", "pg", ["k"], build, ["products", "words"])
    put(D1, "products", [("p1", "a"), ("p2", "a")], "k string, w string")
    assert run(D1) is None  # the other one isn't there yet
    put(D1, "words", [("a", 1)], "w string, n int")
    assert (run(D1).rows_in, run(D2)) == (2, None)
    put(D2, "words", [("a", 2)], "w string, n int")
    assert run(D2).rows_written == 2 and {r.n for r in lake.read(lake.path("silver", "products")).collect()} == {2}
    lake.delete(lake.path("silver", "products"))
    assert run(D3).rows_written == 2


def test_changes_and_activity_jobs(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()
    change = lambda i, **x: {"change_id": i, "customer_unique_id": "u1", "new_zip_code_prefix": "9", "new_city": "rio", "new_state": "RJ", "requested_at": "2017-03-01 08:00:00", "source": "crm"} | x
    land_lines(str(tmp_path / "crm"), "a.jsonl", [change("a"), change("a"), change("b", new_state=" paraná"), change("c", new_city=None), change("d", customer_unique_id="nobody"), change("e", new_state="??")])
    (tmp_path / "crm" / "b.jsonl").write_text("{no json\n")
    page = {"page": 1, "data": [{"customer_unique_id": "u1", "activity_date": "2017-03-01", "sessions": "2"}, {"customer_unique_id": "u1", "activity_date": "x", "sessions": "2"}]}
    land_lines(str(tmp_path / "api"), "p1.json", [page])
    BronzeJob(lake, ledger, D1).lines(str(tmp_path / "crm"))
    BronzeJob(lake, ledger, D1).pages(str(tmp_path / "api"))
    geo, people = spark.createDataFrame([("9", "Rio")], "zip_code_prefix string, city string"), spark.createDataFrame([("u1",)], "customer_unique_id string")
    job = SilverJob(lake, ledger, D1)
    run = job.process(customer_changes_job(geo, people))
    assert (run.rows_in, run.rows_valid, run.rows_quarantined, run.rows_duplicate, run.rows_written) == (7, 3, 3, 1, 3)
    assert run.detail == "corrupt_record=1, invalid_state=1, unknown_customer=1, states_fixed=1, cities_filled=1"
    run = job.process(customer_activity_job(people))
    assert (run.rows_in, run.rows_valid, run.rows_quarantined) == (2, 1, 1) and "invalid_date=1" in run.detail and "missing_device=1" in run.detail
    assert ledger.runs[f"silver/customer_activity/{D1}"]["detail"] == run.detail


def test_rows_wait_from_the_batch_that_saw_them_and_a_refresh_clears(spark, tmp_path):
    lake, ledger = Lake(spark, str(tmp_path / "lake")), Ledger()
    run_day(spark, lake, ledger, D1)
    far = date(2017, 4, 1)
    known = lake.read(lake.path("silver", "orders"))
    items = TableJob("order_items", "pg", ["order_id", "order_item_id"], [F.desc("updated_at")], lambda df: tag_order_children(df, known, ["order_id"]), "order_purchase_date")
    refreshed = SilverJob(lake, ledger, far, full_refresh=True).process(items)
    assert (refreshed.rows_pending, refreshed.rows_quarantined, refreshed.rows_valid) == (1, 0, 1)  # seen anew, it waits anew
    assert lake.partitions(lake.path("silver", "_pending", "order_items"), "batch_date") == [far]
    assert SilverJob(lake, Ledger(), date(2017, 2, 1)).process(items).detail == "nothing to do"


def test_a_broken_swap_loses_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = lambda n: spark.range(n).withColumn("day", F.lit(D1))
    target, staged = lake.path("t", "day=1"), lake.path("_staging", "x")
    rows(3).write.parquet(target)
    rows(5).write.parquet(staged)
    with pytest.raises(OSError, match="could not be moved"):
        lake.swap(lake.path("_staging", "absent"), target)  # fails between the steps
    assert lake.read(target).count() == 3
    aside = lake._path_class(lake.path("t", "._aside_day=1"))
    assert lake.fs.rename(lake._path_class(target), aside) and not lake.exists(target)  # killed between the steps
    lake.recover(lake.path("t"))
    assert lake.read(target).count() == 3
    lake.swap(staged, target)
    assert lake.read(target).count() == 5 and not lake.fs.exists(aside)


def test_the_ledger_outlives_a_broken_save(spark, tmp_path):
    path = str(tmp_path / "ledger.json")
    ledger = Ledger(spark, path)
    ledger.record("silver", "t", D1, IngestRange(D1), LayerRun(1, 1))
    (tmp_path / "ledger.json").rename(tmp_path / "ledger.json.before")  # killed between the steps
    assert Ledger(spark, path).dump() == ledger.dump()
    ledger.record("silver", "t", D2, IngestRange(D2), LayerRun(1, 1))
    assert len(Ledger(spark, path).runs) == 2


def test_replay_days(spark):
    from tidelake.jobs.replay import replay_day
    from tidelake.operators.verify import same_rows

    ddl = "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, order_approved_at timestamp, order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp"
    source = {"orders": spark.createDataFrame([("o1", "c1", "delivered", end(D1), end(D1), end(D2), end(D3))], ddl), "customers": spark.createDataFrame([("c1",), ("c2",)], "customer_id string")}
    state = {"orders": spark.createDataFrame([], ddl + ", updated_at timestamp"), "customers": spark.createDataFrame([], "customer_id string, updated_at timestamp")}
    seen = []
    for d in (D1, D2, D3):
        state = replay_day(state, source, d)
        assert same_rows(state["orders"], replay_day(state, source, d)["orders"])
        seen.append(state["orders"].first().order_status)
    assert seen == ["approved", "shipped", "delivered"] and [r.customer_id for r in state["customers"].collect()] == ["c1"]


def test_measurement(spark):
    from tidelake.jobs.measure import measure, same_summary
    from tidelake.operators.aggregates import salted_sum

    df = spark.range(1000).select(F.lit(1).alias("k"), "id", F.col("id").alias("v"))
    plain = lambda: df.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    salted = lambda: salted_sum(df, ["k"], "v", 4, ["id"])
    found = measure(spark, {"plain": plain, "salted": salted}, runs=1)
    assert [(m.name, m.adaptive) for m in found] == [("plain", False), ("salted", False), ("plain", True), ("salted", True)] and all(m.seconds > 0 for m in found)
    assert same_summary(plain(), salted(), ["k"], "total")
