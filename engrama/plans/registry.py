"""Registry of queries: a name, a DataFrame builder, and the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engrama.sources.adapters import with_ctes

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    """Register a query; `uses` names the model tables that its SQL reads."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = build
        if sql:
            ORACLES[name] = with_ctes(uses, sql)
        return build

    return register
