import json
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tidelake.operators.verify import same_rows
from tidelake.sources import files, generators, jdbc, lake, rest

D1, D2, D3 = date(2017, 3, 1), date(2017, 3, 2), date(2017, 3, 3)


@pytest.fixture
def store(spark, tmp_path):
    return lake.Lake(spark, str(tmp_path / "lake"))


def test_windows():
    high, low = datetime(2017, 3, 2, 23, 59, 59), datetime(2017, 3, 1, 23, 59, 59)
    assert jdbc.Window(high).sql("updated_at") == "updated_at <= TIMESTAMP '2017-03-02 23:59:59'"
    assert jdbc.Window(high, low).sql("updated_at") == "updated_at > TIMESTAMP '2017-03-01 23:59:59' AND updated_at <= TIMESTAMP '2017-03-02 23:59:59'"
    assert jdbc.incremental_query("s", "t", jdbc.Window(high)).startswith("SELECT * FROM s.t WHERE updated_at <=")
    with pytest.raises(ValueError):
        jdbc.incremental_query("s", "t; drop", jdbc.Window(high))


def test_snapshot_is_skipped_if_unchanged(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "a int, b string")
    found, changed = jdbc.changed_snapshot(df, None)
    assert changed and jdbc.changed_snapshot(df.repartition(2), found) == (found, False) and jdbc.changed_snapshot(df.limit(1), found)[1]


def test_partitions_are_replaced_alone(spark, store):
    path, rows = store.path("bronze", "t"), lambda *n: spark.createDataFrame([(i,) for i in n], "id int")
    assert store.read(path) is None and store.read_range(path, None, D3) is None
    assert store.write_batch(rows(1, 2), path, D1, "s", datetime(2017, 3, 1)) == 2
    assert store.write_batch(rows(3), path, D2, "s", datetime(2017, 3, 2)) == 1
    assert store.write_batch(rows(4, 5), path, D2, "s", datetime(2017, 3, 2)) == 2
    assert sorted(r.id for r in store.read(path).collect()) == [1, 2, 4, 5]
    assert store.partitions(path, "ingest_date") == [D1, D2]
    ranged = store.read_range(path, D1, D3)
    assert sorted(r.id for r in ranged.collect()) == [4, 5] and "_bronze_ingest_date" in ranged.columns
    assert "PartitionFilters: [isnotnull(ingest_date" in ranged._jdf.queryExecution().toString()
    assert sorted(r.id for r in store.latest_snapshot(path, D3).collect()) == [4, 5] and store.latest_snapshot(path, date(2017, 2, 1)) is None
    assert store.has_snapshot_in(path, D1, D2) and not store.has_snapshot_in(path, D2, D3)
    assert store.write_batch(rows(), path, D2, "s", datetime(2017, 3, 2)) == 0
    assert store.folders(path) == ["ingest_date=2017-03-01"]


def version(spark, *rows):
    df = spark.createDataFrame(rows, "k string, v int, day date")
    return df.withColumns({"_batch_date": F.col("day"), "_first_batch_date": F.col("day")})


def test_merge_is_idempotent(spark, store):
    path, order = store.path("silver", "t"), [F.desc("v")]
    put = lambda *rows, **more: store.merge(version(spark, *rows), path, ["k"], order, "day", **more)
    put(("a", 1, D1), ("b", 1, D2))
    for _ in range(2):
        assert put(("a", 2, D1), ("c", 1, D1)) == 2
    put(("a", 1, D1))
    read = lambda: sorted((r.k, r.v) for r in store.read(path).collect())
    assert read() == [("a", 2), ("b", 1), ("c", 1)] and store.folders(store.path("_staging")) == []
    put(("z", 1, D1), union_existing=False)
    assert read() == [("b", 1), ("z", 1)]
    put(("y", 1, D3), full_refresh=True)
    assert read() == [("y", 1)] and store.as_of(path, D2).isEmpty() and store.as_of(path, D3).count() == 1
    assert store.merge(version(spark, ("w", 1, D1)), store.path("silver", "u"), ["k"], order) == 1


def test_regroup_and_ddl(spark, store):
    df = version(spark, ("a", 1, D1), ("b", 1, D2))
    store.regroup(df, store.path("m"), "month", F.date_format("day", "yyyy-MM"))
    assert store.folders(store.path("m")) == ["month=2017-03"]
    ddl = lake.table_ddl("db", "t", df.withColumn("n", F.lit(1).cast("long")), "s3://x/t", "day")
    assert "`n` bigint" in ddl and "PARTITIONED BY (`day` date)" in ddl and ddl.count("`day`") == 1
    assert [x.count("PARTITION") for x in lake.add_partitions_ddl("db", "t", "day", [str(i) for i in range(150)], "x")] == [100, 50]
    lake.register(spark, "m", store.path("m"))
    assert spark.sql("SELECT count(*) FROM m WHERE month = '2017-03'").first()[0] == 2


CHANGE = {"change_id": "c1", "customer_unique_id": "u1", "new_zip_code_prefix": "01037", "new_city": "sao paulo", "new_state": "SP", "requested_at": "2017-03-01 10:00:00", "source": "crm_portal"}


def test_json_lines(spark, tmp_path):
    path = files.land_lines(str(tmp_path), "changes.jsonl", [CHANGE, CHANGE | {"new_city": None}])
    with open(path, "a", encoding="utf-8") as f:
        f.write('{"change_id": "c4", "customer\n')
    rows = files.read_json_lines(spark, str(tmp_path)).collect()
    bad = [r for r in rows if r._corrupt_record]
    assert len(rows) == 3 and len(bad) == 1 and bad[0]._corrupt_record.startswith('{"change_id": "c4"') and bad[0]._source_file.endswith("changes.jsonl")


def page(number, rows, pages=1, total=None):
    return json.dumps({"page": number, "total_pages": pages, "total_records": len(rows) if total is None else total, "data": rows}).encode()


def test_json_pages(spark, tmp_path):
    folder = files.land_pages(str(tmp_path / "day"), [(1, page(1, [{"customer_unique_id": "u1", "sessions": "2"}, {"customer_unique_id": "u2"}])), (2, page(2, [])), (3, b'{"page": 99, "data": [ {"customer_unique_id": ')])
    rows = files.read_json_pages(spark, folder).collect()
    assert sorted((r.customer_unique_id or "", r._page or 0) for r in rows if not r._corrupt_record) == [("u1", 1), ("u2", 1)]
    assert [r._corrupt_record[:12] for r in rows if r._corrupt_record] == ['{"page": 99,']
    files.land_pages(folder, [(1, page(1, []))])
    assert files.read_json_pages(spark, folder).collect() == []


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name,n\nb,,2\na,x,\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "id string, name string, n int", "row_id", ["id"])
    assert sorted(map(tuple, df.collect())) == [("a", "x", None, 1), ("b", None, 2, 2)]
    with pytest.raises(ValueError, match="other"):
        files.read_csv(spark, str(tmp_path / "a.csv"), "other string")
    pool = spark.createDataFrame([("2", "b", "SP"), ("1", "a", "SP"), ("1", "a", "SP")], "geolocation_zip_code_prefix string, geolocation_city string, geolocation_state string")
    assert [r[0] for r in files.address_pool(pool).collect()] == ["1", "2"]
    assert len(files.grouped(pool, "geolocation_zip_code_prefix", ["geolocation_city"]).where("geolocation_zip_code_prefix = '1'").first()["rows"]) == 2


class Service:
    def __init__(self, answers):
        self.answers, self.waits = list(answers), []

    def client(self, **more):
        def send(day, number, size):
            got = self.answers.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return rest.PagedClient(send, sleep=self.waits.append, **more)


def test_client_retries():
    fine = rest.Response(200, page(1, [{}]))
    s = Service([rest.Response(429, headers={"Retry-After": "7"}), OSError("reset"), rest.Response(500), fine])
    assert s.client().day(D1) == [(1, fine.body)]
    assert s.waits[0] == 7 and 0.5 <= s.waits[1] <= 1 and 1 <= s.waits[2] <= 2
    with pytest.raises(ConnectionError):
        Service([rest.Response(500)] * 5).client().day(D1)
    with pytest.raises(ValueError, match="404"):
        Service([rest.Response(404)]).client().day(D1)
    with pytest.raises(rest.IncompletePages):
        Service([rest.Response(200, page(1, [{}], total=3))]).client().day(D1)
    two = [rest.Response(200, page(i, [{}], pages=2, total=2)) for i in (1, 2)]
    assert len(Service(two).client().day(D1)) == 2
    assert Service([]).client(longest=3.0).wait(50) <= 3


def test_retry_after():
    now = datetime(2017, 3, 1, tzinfo=UTC)
    assert rest.retry_after("12") == 12 and rest.retry_after(None) is None and rest.retry_after("soon") is None
    assert rest.retry_after("Wed, 01 Mar 2017 00:00:30 GMT", now) == 30 and rest.retry_after("Wed, 01 Mar 2017 00:00:00 GMT", datetime(2018, 1, 1, tzinfo=UTC)) == 0


def test_generators(spark):
    orders = spark.createDataFrame([(f"u{i}", datetime(2017, 3, 1 + i % 9)) for i in range(3000)], "customer_unique_id string, order_purchase_timestamp timestamp")
    day = date(2017, 3, 9)
    a = generators.customer_activity(orders, day, dirty=0.3)
    assert same_rows(a, generators.customer_activity(orders.repartition(3), day, dirty=0.3))
    n = a.count()
    assert 150 < n < 600 and 0.1 * n < a.where("page_views IS NULL OR sessions < 0 OR last_seen_at LIKE '%/%'").count() < 0.5 * n
    pool = spark.createDataFrame([("1", "a", "SP"), ("2", "b", "RJ")], "z string, c string, s string")
    ch = generators.customer_changes(orders, pool, day, rate=0.2, dirty=0.4)
    ids = ch.count(), ch.select("change_id").distinct().count()
    assert 400 < ids[1] < 800 and ids[0] > ids[1] and ch.where("customer_unique_id LIKE 'ghost-%'").count() > 0
    assert same_rows(ch, generators.customer_changes(orders, pool, day, rate=0.2, dirty=0.4))
