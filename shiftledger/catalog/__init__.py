"""The registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scans", "filters", "warehouse", "calendar", "dashboards", "targets", "quality", "streams", "stored")


def all_queries():
    """All queries by key, in the order of their modules."""
    for name in MODULES:
        import_module(f"shiftledger.catalog.{name}")
    from shiftledger.catalog.base import QUERIES

    return QUERIES
