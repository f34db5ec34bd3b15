"""Named queries over the shared tables, each with the SQL that defines its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL definition."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    from priorsight.catalog import (  # noqa: F401
        encodings,
        evaluation,
        feature_statistics,
        histories,
        modelling,
        profiles,
        scalar_queries,
        shaping,
        splitting,
        users,
        windows,
    )
