"""Cleaned tables from raw batches: range, read, retry what waits, transform, route, merge, record."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cleaning import Triple, add_row_metadata, clean_customer_activity, clean_customer_changes
from ..operators.orders import affected_days, order_lines
from ..operators.routing import REASON, late_status
from ..sources.lake import Lake
from ..sources.shared import checkpointed
from .ledger import IngestRange, LayerRun, Ledger

Transform = Callable[[DataFrame], DataFrame | Triple]


@dataclass(frozen=True)
class TableJob:
    """``transform`` takes the latest raw row of each key and adds _reason and what the clean table needs; or, with
    ``whole``, takes all raw rows and gives (valid, rejected with _reason, one row with the number of duplicates).

    ``fixes``: conditions on valid rows that are counted, for the ledger."""

    name: str
    source: str
    keys: Sequence[str]
    order: Sequence[Column]
    transform: Transform
    partition: str | None = None
    corrupt: str | None = None
    whole: bool = False
    fixes: Mapping[str, Column] = field(default_factory=dict)


def customer_changes_job(geolocation: DataFrame, customers: DataFrame) -> TableJob:
    fixes = {"states_fixed": F.col("_state_fixed"), "cities_filled": F.col("_city_filled")}
    order = [F.desc("_bronze_ingest_date"), F.desc("_source_file")]
    return TableJob("customer_changes", "crm", ["change_id"], order, lambda raw: clean_customer_changes(raw, geolocation, customers), "requested_date", whole=True, fixes=fixes)


def customer_activity_job(customers: DataFrame) -> TableJob:
    lacks = {f"missing_{n}": F.col(c).isNull() for n, c in (("page_views", "page_views"), ("device", "device"), ("last_seen", "last_seen_at"))}
    order = [F.desc("_bronze_ingest_date"), F.desc("_source_file")]
    return TableJob("customer_activity", "api", ["customer_unique_id", "activity_date"], order, lambda raw: clean_customer_activity(raw, customers), "activity_date", whole=True, fixes={"timestamps_reparsed": F.col("_timestamp_reformatted"), **lacks})


FIRST = "_first_seen_batch"


class SilverJob:
    def __init__(self, lake: Lake, ledger: Ledger, day: date, full_refresh: bool = False, waiting_days: int = 7):
        self.lake, self.ledger, self.day, self.full_refresh, self.waiting_days = lake, ledger, day, full_refresh, waiting_days
        self.reference_changed = False

    def waiting(self, table: str) -> DataFrame | None:
        """Rows that the previous batch of the table left pending; of no other batch."""
        before = None if self.full_refresh else self.ledger.last_run("silver", table, self.day)
        path = self.lake.path("silver", "_pending", table)
        return None if before is None else self.lake.read(f"{path}/batch_date={before}")

    def _routed(self, job: TableJob, rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(valid rows, rejected raw rows with their reason, the number of duplicates, which is counted by itself)."""
        names = rows.columns
        if job.whole:
            valid, rejected, duplicates = job.transform(rows)
            return checkpointed(valid), checkpointed(rejected.select(*names, REASON)), int(duplicates.first()[0])
        corrupt = rows.where(F.col(job.corrupt).isNotNull()) if job.corrupt else None
        good = rows.where(F.col(job.corrupt).isNull()) if job.corrupt else rows
        ranked = good.withColumn("_raw", F.struct(*names)).withColumn("_nth", _rank(job))
        duplicates = ranked.where("_nth > 1").count()
        tagged = checkpointed(job.transform(ranked.where("_nth = 1")))  # one computation for all outcomes
        rejected = tagged.where(F.col(REASON).isNotNull()).select(*[F.col(f"_raw.{c}").alias(c) for c in names], REASON)
        if corrupt is not None:
            rejected = rejected.unionByName(corrupt.select(*names).withColumn(REASON, F.lit("corrupt_record")))
        drop = ["_raw", "_nth", REASON, FIRST, *([job.corrupt] if job.corrupt else [])]
        return tagged.where(F.col(REASON).isNull()).drop(*drop), rejected, duplicates

    def process(self, job: TableJob) -> LayerRun:
        """Cleans a table's new raw rows, and those that waited; a row's age counts from the batch that first saw it."""
        covered = self.ledger.range("silver", job.name, self.day, self.full_refresh)
        aside = {kind: self.lake.path("silver", kind, job.name) for kind in ("_quarantine", "_pending")}
        if self.full_refresh:
            for path in aside.values():
                self.lake.delete(path)
        raw = self.lake.read_range(self.lake.path("bronze", job.source, job.name), covered.low, covered.high)
        held = self.waiting(job.name)
        today = F.lit(self.day).cast("date")
        raw = raw.withColumn(FIRST, today) if raw is not None else None
        rows = raw if held is None else held if raw is None else raw.unionByName(held.select(*raw.columns))
        total = 0 if rows is None else rows.count()
        if not total:
            for path in aside.values():  # of an earlier run of this day
                self.lake.delete(f"{path}/batch_date={self.day}")
            return self._done(job.name, covered, LayerRun(detail="nothing to do"))
        valid, rejected, duplicates = self._routed(job, rows)
        status = late_status(F.col(REASON), F.col(FIRST), today, days=self.waiting_days)
        rejected = checkpointed(rejected.withColumn("_status", status))
        late = rejected.where("_status = 'pending'").drop("_status", REASON)
        out = rejected.where("_status = 'quarantined'").drop("_status")
        reasons = {r[0]: r[1] for r in out.groupBy(REASON).agg(F.count("*")).collect()}
        quarantined, pending = self.lake.quarantine(out, aside["_quarantine"], self.day), self.lake.quarantine(late, aside["_pending"], self.day)
        found = valid.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in job.fixes.items()]).first().asDict()
        n, written = found.pop("n"), 0
        if n:
            order = list(job.order) or [F.desc("_batch_date")]
            stamped = add_row_metadata(valid.drop(FIRST), today, F.lit(datetime.now(UTC).replace(tzinfo=None)))
            written = self.lake.merge(stamped, self.lake.path("silver", job.name), job.keys, order, job.partition, self.full_refresh)
        retried = held.count() if held is not None else 0
        detail = [f"{k}={v}" for k, v in sorted(reasons.items())]
        detail += [f"pending: {retried} retried, {pending} still waiting"] if retried or pending else []
        detail += [f"{k}={v}" for k, v in found.items()]
        return self._done(job.name, covered, LayerRun(total, n, quarantined, duplicates, written, pending, ", ".join(detail)))

    def _done(self, name: str, covered: IngestRange, run: LayerRun) -> LayerRun:
        self.ledger.record("silver", name, self.day, covered, run)
        return run

    def reference(self, name: str, source: str, keys: Sequence[str], build: Callable[..., DataFrame], tables: Sequence[str] = ()) -> LayerRun | None:
        """Rebuilds a whole table from the newest snapshots of ``tables`` (by default the one of its name), which ``build``
        takes in order. None if the table is there and none of them has a new snapshot in the range, or one has none."""
        covered, path = self.ledger.range("silver", name, self.day, self.full_refresh), self.lake.path("silver", name)
        paths = [self.lake.path("bronze", source, t) for t in tables or (name,)]
        there = self.lake.exists(path)
        if there and not any(self.lake.has_snapshot_in(p, covered.low, covered.high) for p in paths):
            return None
        snapshots = [self.lake.latest_snapshot(p, self.day) for p in paths]
        if any(s is None for s in snapshots):
            return None
        rows = snapshots[0].count()
        made = add_row_metadata(build(*snapshots), F.lit(self.day), F.lit(datetime.now(UTC).replace(tzinfo=None)))
        written = self.lake.merge(made, path, keys, [F.desc("_batch_date")], full_refresh=True)
        self.reference_changed |= there
        return self._done(name, covered, LayerRun(rows, written, 0, rows - written, written, detail="rebuilt"))

    def order_lines(self, everything: bool = False) -> LayerRun:
        """Rebuilds the days of order_lines that this batch's orders, items or payments touch; all of them after a full
        refresh or a change of a reference table (``everything``)."""
        everything = everything or self.reference_changed
        t = {n: self.lake.read(self.lake.path("silver", n)) for n in ("order_items", "orders", "order_payments", "customers", "products", "sellers")}
        sources, today = ("orders", "order_items", "order_payments"), F.lit(self.day).cast("date")
        covered = self.ledger.range("silver", "order_lines", self.day, self.full_refresh)
        if absent := [n for n, df in t.items() if df is None]:
            return self._done("order_lines", covered, LayerRun(detail=f"not there yet: {', '.join(absent)}"))
        if not (everything or self.full_refresh):
            days = [r[0] for r in affected_days([t[n].where(F.col("_batch_date") == today) for n in sources]).collect()]
            for n in sources:  # a literal list, which prunes partitions
                t[n] = t[n].where(F.col("order_purchase_date").isin(days)) if days else t[n].limit(0)
        lines = checkpointed(order_lines(*t.values()))
        rows, written = lines.count(), 0
        if rows:
            made = add_row_metadata(lines, today, F.lit(datetime.now(UTC).replace(tzinfo=None)))
            written = self.lake.merge(made, self.lake.path("silver", "order_lines"), ["order_id", "order_item_id"], [F.desc("_batch_date")], "order_purchase_date", everything or self.full_refresh, union_existing=False)
        return self._done("order_lines", covered, LayerRun(rows_in=rows, rows_valid=rows, rows_written=written))


def _rank(job: TableJob) -> Column:
    return F.row_number().over(Window.partitionBy(*job.keys).orderBy(*job.order, F.desc("_bronze_ingest_date")))
