"""Joins of an event to what happened strictly before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.plans.timegrid import last_rows_before, measure_widths
from priorsight.plans.windows import totals_before, window_totals


def history_counts(
    events: DataFrame, queries: DataFrame, keys: Sequence[str] = ("id",), name: str = "events_before"
) -> DataFrame:
    """Number of events of the same key strictly before each query row."""
    return totals_before(events, queries, keys, {name: F.lit(1).cast("long")})


def trailing_counts(
    events: DataFrame,
    queries: DataFrame,
    days: Sequence[int],
    keys: Sequence[str] = ("id",),
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Counts, or other sums, over the events less than ``d`` days before each query row."""
    measures = measures or {"events": F.lit(1).cast("long")}
    return window_totals(events, queries, keys, measures, days)


def link_last_events(
    events: DataFrame,
    queries: DataFrame,
    payload: Sequence[str],
    k: int = 3,
    keys: Sequence[str] = ("id",),
    order: str = "log_id",
) -> DataFrame:
    """The ``k`` latest earlier events as structs ``last_0 .. last_{k-1}``, newest first."""
    widths = measure_widths([events, queries], keys)
    return last_rows_before(events, queries, keys, payload, k, widths, order)


def with_last_event(
    events: DataFrame,
    queries: DataFrame,
    payload: Mapping[str, str],
    keys: Sequence[str] = ("id",),
    order: str = "log_id",
) -> DataFrame:
    """Queries with columns of the latest earlier event; ``payload`` maps event column to new name."""
    linked = link_last_events(events, queries, list(payload), 1, keys, order)
    return linked.select(
        *queries.columns, *[F.col(f"last_0.{c}").alias(name) for c, name in payload.items()]
    )


def flag_linked(
    logins: DataFrame, links: DataFrame, login_key: str = "log_id", link_key: str = "recent_login_id_0"
) -> DataFrame:
    """Logins with ``has_trade``: 1 where some trade has the login as its latest one."""
    used = links.select(F.col(link_key).alias(login_key)).filter(F.col(login_key).isNotNull()).distinct()
    flagged = logins.join(used.withColumn("has_trade", F.lit(1)), login_key, "left")
    return flagged.withColumn("has_trade", F.coalesce("has_trade", F.lit(0)))


def linked_only(
    logins: DataFrame, links: DataFrame, login_key: str = "log_id", link_key: str = "recent_login_id_0"
) -> DataFrame:
    used = links.select(F.col(link_key).alias(login_key))
    return logins.join(used, login_key, "left_semi")


def unlinked_only(
    logins: DataFrame, links: DataFrame, login_key: str = "log_id", link_key: str = "recent_login_id_0"
) -> DataFrame:
    used = links.select(F.col(link_key).alias(login_key))
    return logins.join(used, login_key, "left_anti")


def attach_details(
    trades: DataFrame, logins: DataFrame, link: str, suffix: str, columns: Sequence[str], login_key: str = "log_id"
) -> DataFrame:
    """Left join of the linked login's columns, each with a suffix."""
    details = logins.select(
        F.col(login_key).alias(link), *[F.col(c).alias(c + suffix) for c in columns]
    )
    return trades.join(details, link, "left")
