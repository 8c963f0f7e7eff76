"""Registered queries of the archive engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.views import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Views], DataFrame], sql: str | None = None, *views: str) -> None:
    """Add a query over the canonical views; ``sql`` is its twin over the named DuckDB views."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
    if sql is not None:
        ORACLES[name] = with_views(sql, *views) if views else sql


def _load() -> None:
    from tessera.plans import queries_archive, queries_jobs, queries_raw, queries_reports, queries_rules  # noqa: F401


_load()
