"""All registered queries by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["extraction", "analysis", "tracking", "tables", "reporting", "storage"]


def all_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"pageprism.plans.{name}").QUERIES)
    return found
