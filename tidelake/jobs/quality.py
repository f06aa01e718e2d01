"""The quality gate: runs a layer's suite over the lake for one day or several. Exit status 1 if anything blocks."""

from __future__ import annotations

import argparse
from datetime import date, timedelta

from ..dq.runner import Result, Runner, exit_code, report
from ..dq.suite import Suite, load_suite
from ..session import build_session
from ..sources.lake import Lake
from .ledger import Ledger


def run_layer(lake: Lake, ledger: Ledger, layer: str, day: date, suite: Suite | None = None, only: set[str] | None = None) -> list[Result]:
    results = Runner(suite or load_suite(layer), day, lambda name: lake.read(lake.path(*name.split("."))), lambda t, c: ledger.previous_observed(t, c, day)).run(only)
    ledger.record_checks(layer, day, results)
    return results


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--layer", required=True, choices=["bronze", "silver", "gold"])
    p.add_argument("--date", type=date.fromisoformat)
    p.add_argument("--start", type=date.fromisoformat)
    p.add_argument("--end", type=date.fromisoformat)
    p.add_argument("--table", action="append")
    p.add_argument("--suite")
    a = p.parse_args(argv)
    if (a.date is None) == (a.start is None or a.end is None):
        p.error("give --date, or --start and --end")
    spark = build_session("quality")
    lake, ledger = Lake(spark, a.root), Ledger(spark, f"{a.root}/ledger.json")
    day, last, worst = a.date or a.start, a.date or a.end, 0
    while day <= last:
        results = run_layer(lake, ledger, a.layer, day, load_suite(a.layer, a.suite) if a.suite else None, set(a.table) if a.table else None)
        print(f"{a.layer} {day}\n{report(results)}")
        worst, day = max(worst, exit_code(results)), day + timedelta(days=1)
    return worst


if __name__ == "__main__":
    raise SystemExit(main())
