"""Registered queries on the driver tables, each with its DuckDB statement."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("energy", "experiments", "safety", "answers", "monitoring", "learning")


def load() -> tuple[dict, dict]:
    """Import all query groups and return (queries, oracles)."""
    from ampersift.queries import registry

    for group in GROUPS:
        import_module(f"ampersift.queries.{group}")
    return registry.QUERIES, registry.ORACLES
