"""Raw tables: a batch of each source, exactly as sent, in a partition that a rerun replaces."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame

from ..sources.files import read_json_lines, read_json_pages
from ..sources.jdbc import Window, changed_snapshot
from ..sources.lake import Lake
from .ledger import Ledger


class BronzeJob:
    def __init__(self, lake: Lake, ledger: Ledger, day: date):
        self.lake, self.ledger, self.day = lake, ledger, day

    def _write(self, df: DataFrame, source: str, table: str) -> int:
        return self.lake.write_batch(df, self.lake.path("bronze", source, table), self.day, f"{source}.{table}", datetime.now(UTC).replace(tzinfo=None))

    def incremental(self, source: str, table: str, read: Callable[[Window], DataFrame]) -> int:
        """Rows changed in the day's window; the ledger is written only after the data."""
        window = self.ledger.window(source, table, datetime(self.day.year, self.day.month, self.day.day, 23, 59, 59))
        rows = self._write(read(window), source, table)
        self.ledger.record_ingest(source, table, window, rows)
        return rows

    def reference(self, source: str, table: str, read: Callable[[], DataFrame]) -> int | None:
        """A whole table, or None if it is as the newest snapshot was. A table that changes meanwhile is an error."""
        known = self.ledger.snapshot_hash(source, table, self.day)
        found, changed = changed_snapshot(read(), known)
        if not changed:
            return None
        rows = self._write(read(), source, table)
        if changed_snapshot(read(), found)[1]:
            raise RuntimeError(f"{source}.{table} changed while it was read")
        self.ledger.record_snapshot(source, table, self.day, found, rows)
        return rows

    def lines(self, folder: str, source: str = "crm", table: str = "customer_changes") -> int:
        return self._write(read_json_lines(self.lake.spark, folder), source, table)

    def pages(self, folder: str, source: str = "api", table: str = "customer_activity") -> int:
        return self._write(read_json_pages(self.lake.spark, folder), source, table)
