"""Where the query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, build: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    """Register ``build`` (views -> result) and, where SQL can say the same, its SQL twin."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = sql


def load() -> None:
    """Import every query module once."""
    from . import queries_cadence, queries_findings, queries_inventory, queries_network, queries_scoring, queries_sources, queries_streams  # noqa: F401
