"""All checking SQL by query name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["extract", "analysis", "tracking", "tables", "reporting", "storage"]


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"oracle.{name}").SQL)
    return found
