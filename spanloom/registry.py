"""All registered queries: name to function, and name to the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

AREAS = ("rollups", "cost", "drift", "evals", "alerts", "rca", "streams", "more", "wider", "stored", "rules", "deeper")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _area in AREAS:
    _module = import_module(f"spanloom.queries.{_area}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
