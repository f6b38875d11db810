"""Composed jobs, test fixtures and the registered queries."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """Registered queries and their SQL, by name."""
    from annolake.plans import registry

    for module in ("queries_catalog", "queries_geometry", "queries_metrics", "queries_raster", "queries_files", "queries_jobs", "queries_snapshots"):
        __import__(f"annolake.plans.{module}")
    return registry.QUERIES, registry.ORACLES
