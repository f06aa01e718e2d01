"""The ledger: which batch of which table covered what, and what quality checks saw.

State is a JSON document on any Hadoop file system, written aside and renamed. Each record replaces the one of its key,
so a rerun leaves one; windows of a day follow from the latest run before it, so a rerun gets the window it had.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import date, datetime

from pyspark.sql import SparkSession

from ..sources.jdbc import Window


@dataclass(frozen=True)
class IngestRange:
    """Batches in (low, high]; no low is everything up to high."""

    high: date
    low: date | None = None


@dataclass
class LayerRun:
    rows_in: int = 0
    rows_valid: int = 0
    rows_quarantined: int = 0
    rows_duplicate: int = 0
    rows_written: int = 0
    rows_pending: int = 0
    detail: str = ""

    def balances(self) -> bool:
        return self.rows_in == self.rows_valid + self.rows_quarantined + self.rows_duplicate + self.rows_pending


class Ledger:
    """In memory, or kept at ``path``."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.runs: dict[str, dict] = {}
        self.checks: dict[str, dict] = {}
        self.marks: dict[str, str] = {}
        self.snapshots: dict[str, dict] = {}
        self.spark, self.path = spark, path
        if path:
            self._class = spark._jvm.org.apache.hadoop.fs.Path
            self.fs = self._class(path).getFileSystem(spark._jsc.hadoopConfiguration())
            for place in (path, f"{path}.before"):
                if self.fs.exists(self._class(place)):
                    self.load("".join(r[0] for r in spark.read.text(place, wholetext=True).collect()))
                    break

    def load(self, text: str) -> None:
        for name, value in json.loads(text).items():
            setattr(self, name, value)

    def dump(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("runs", "checks", "marks", "snapshots")}, indent=1, sort_keys=True)

    def save(self) -> None:
        if not self.path:
            return
        aside, final = self._class(f"{self.path}.{uuid.uuid4().hex}"), self._class(self.path)
        out = self.fs.create(aside, True)
        out.write(bytearray(self.dump(), "utf-8"))
        out.close()
        before = self._class(f"{self.path}.before")  # read if a failure leaves no other
        self.fs.delete(before, False)
        if self.fs.exists(final) and not self.fs.rename(final, before):
            raise OSError(f"{self.path} could not be moved aside")
        if not self.fs.rename(aside, final):
            raise OSError(f"{self.path} could not be written; the last state is in {self.path}.before")

    # ingestion from sources: windows of time

    def window(self, source: str, table: str, high: datetime) -> Window:
        """(high of the latest ingest before this day, high]."""
        earlier = [m for k, m in self.runs.items() if k.startswith(f"ingest/{source}.{table}/") and m["high"][:10] < str(high.date())]
        low = max((m["high"] for m in earlier), default=None)
        return Window(high, datetime.fromisoformat(low) if low else None)

    def record_ingest(self, source: str, table: str, window: Window, rows: int) -> None:
        """The run, and the watermark, which never moves back."""
        self.runs[f"ingest/{source}.{table}/{window.high.date()}"] = {"low": window.low and window.low.isoformat(), "high": window.high.isoformat(), "rows": rows}
        key = f"{source}.{table}"
        self.marks[key] = max(self.marks.get(key, ""), window.high.isoformat())
        self.save()

    # layers: ranges of batches

    def last_run(self, layer: str, table: str, before: date) -> date | None:
        days = [k.rsplit("/", 1)[1] for k in self.runs if k.startswith(f"{layer}/{table}/")]
        return max((date.fromisoformat(d) for d in days if d < str(before)), default=None)

    def range(self, layer: str, table: str, day: date, full_refresh: bool = False) -> IngestRange:
        return IngestRange(day, None if full_refresh else self.last_run(layer, table, day))

    def record(self, layer: str, table: str, day: date, covered: IngestRange, run: LayerRun) -> None:
        if not run.balances():
            raise ValueError(f"{layer}.{table} of {day}: rows don't balance: {run}")
        self.runs[f"{layer}/{table}/{day}"] = {"low": covered.low and str(covered.low), "high": str(covered.high), **asdict(run)}
        self.save()

    # quality and snapshots

    def previous_observed(self, table: str, check: str, before: date) -> float | None:
        """The latest count that a check saw before a day."""
        found = [(k.rsplit("/", 1)[1], v["observed"]) for k, v in self.checks.items() if k.startswith(f"{table}/{check}/") and v["observed"] is not None]
        return max((x for x in found if x[0] < str(before)), default=(None, None))[1]

    def record_checks(self, layer: str, day: date, results: list) -> None:
        """In place of all results of these tables on this day."""
        tables = {r.table for r in results}
        self.checks = {k: v for k, v in self.checks.items() if not (v["table"] in tables and k.endswith(f"/{day}"))}
        self.checks |= {f"{r.table}/{r.check}/{day}": {"layer": layer, "table": r.table, "status": r.status, "observed": r.observed, "failed_rows": r.failed_rows} for r in results}
        self.save()

    def snapshot_hash(self, source: str, table: str, day: date) -> str | None:
        """The hash of the newest snapshot up to a day."""
        found = {k.rsplit("/", 1)[1]: v["hash"] for k, v in self.snapshots.items() if k.startswith(f"{source}.{table}/")}
        return found[max(d for d in found if d <= str(day))] if any(d <= str(day) for d in found) else None

    def record_snapshot(self, source: str, table: str, day: date, content: str, rows: int) -> None:
        self.snapshots[f"{source}.{table}/{day}"] = {"hash": content, "rows": rows}
        self.save()

    # moving state between environments

    def export(self, before: date) -> str:
        """The latest run and observation of each table before a day, as JSON."""
        keep: dict[str, dict] = {}
        for name in ("runs", "checks"):
            latest: dict[str, str] = {}
            for k in getattr(self, name):
                head, _, day = k.rpartition("/")
                if day < str(before):
                    latest[head] = max(latest.get(head, ""), day)
            keep[name] = {f"{h}/{d}": getattr(self, name)[f"{h}/{d}"] for h, d in latest.items()}
        return json.dumps({**keep, "marks": self.marks, "snapshots": self.snapshots})

    def absorb(self, text: str) -> tuple[int, int]:
        """Takes in another ledger's records; (runs, checks) that it had."""
        other = json.loads(text)
        self.runs |= other["runs"]
        self.checks |= other["checks"]
        self.marks |= {k: max(v, self.marks.get(k, "")) for k, v in other["marks"].items()}
        self.snapshots |= other["snapshots"]
        self.save()
        return len(other["runs"]), len(other["checks"])
