"""All queries over the operators."""

from __future__ import annotations

from . import checks, relational, warehouse
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "relational", "warehouse"]
