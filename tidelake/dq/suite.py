"""Suites: what to check of each table of a layer."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

# The checks with the parameters that they need, and those that they may have.
TYPES: dict[str, set[str]] = {
    "not_null": {"columns"},
    "unique": {"columns"},
    "accepted_values": {"column", "values"},
    "range": {"column"},
    "expression": {"expr"},
    "schema": {"columns"},
    "relationship": {"column", "ref"},
    "row_count_vs_previous": set(),
}
OPTIONAL = {"accepted_values": {"allow_null"}, "range": {"min", "max"}, "schema": {"allow_extra"}, "relationship": {"ref_where"}, "row_count_vs_previous": {"min_ratio", "max_ratio"}}
COMMON = {"type", "name", "severity", "scope", "where"}
SCOPES, SEVERITIES = ("batch", "table", "latest"), ("error", "warn")


class SuiteError(ValueError):
    """A suite that can't be run as it is written."""


@dataclass(frozen=True)
class Check:
    name: str
    type: str
    severity: str
    scope: str
    where: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str, default: Any = None) -> Any:
        return self.params.get(key, default)

    def __getitem__(self, key: str) -> Any:
        return self.params[key]


@dataclass(frozen=True)
class TableChecks:
    table: str
    key: tuple[str, ...]
    batch_column: str
    optional: bool
    checks: tuple[Check, ...]


@dataclass(frozen=True)
class Suite:
    layer: str
    tables: tuple[TableChecks, ...]


def _name(spec: dict[str, Any]) -> str:
    if "name" in spec:
        return str(spec["name"])
    about = spec.get("columns") or ([spec["column"]] if "column" in spec else [])
    return "_".join([spec["type"], *(map(str, about) if spec["type"] != "schema" else [])])


def _check(table: str, spec: Any, scope: str) -> Check:
    if not isinstance(spec, dict) or spec.get("type") not in TYPES:
        raise SuiteError(f"{table}: unknown check type {spec.get('type') if isinstance(spec, dict) else spec!r}")
    kind = spec["type"]
    params = {k: v for k, v in spec.items() if k not in COMMON}
    if absent := TYPES[kind] - params.keys():
        raise SuiteError(f"{table}: {kind} needs {', '.join(sorted(absent))}")
    if unknown := params.keys() - TYPES[kind] - OPTIONAL.get(kind, set()):
        raise SuiteError(f"{table}: {kind} has unknown parameters {', '.join(sorted(unknown))}")
    if kind == "range" and not params.keys() & {"min", "max"}:
        raise SuiteError(f"{table}: range needs min or max")
    if kind == "relationship" and len(str(params["ref"]).split(".")) < 3:
        raise SuiteError(f"{table}: relationship's ref is layer.table.column")
    severity, scope = spec.get("severity", "error"), spec.get("scope", scope)
    if severity not in SEVERITIES:
        raise SuiteError(f"{table}: unknown severity {severity!r}")
    if scope not in SCOPES:
        raise SuiteError(f"{table}: unknown scope {scope!r}")
    return Check(_name(spec), kind, severity, scope, spec.get("where"), params)


def parse_suite(layer: str, raw: Any) -> Suite:
    if not isinstance(raw, dict) or not isinstance(raw.get("tables"), dict):
        raise SuiteError(f"{layer}: a suite has tables")
    defaults, out = raw.get("defaults") or {}, []
    for table, spec in raw["tables"].items():
        scope = spec.get("scope", defaults.get("scope", "batch"))
        checks = tuple(_check(table, c, scope) for c in spec.get("checks") or [])
        names = [c.name for c in checks]
        if twice := {n for n in names if names.count(n) > 1}:
            raise SuiteError(f"{table}: more than one check is named {', '.join(sorted(twice))}")
        out.append(TableChecks(table, tuple(spec.get("key") or ()), spec.get("batch_column", defaults.get("batch_column", "_batch_date")), bool(spec.get("optional", False)), checks))
    return Suite(layer, tuple(out))


def load_suite(layer: str, path: str | Path | None = None) -> Suite:
    """A layer's suite from a YAML file, or the one that comes with the library."""
    from .suites import shipped

    if path is None:
        return parse_suite(layer, shipped(layer))
    with open(path, encoding="utf-8") as f:
        return parse_suite(layer, yaml.safe_load(f))
