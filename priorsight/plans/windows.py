"""Trailing windows as sweeps: an event enters at its time and leaves when the window has passed it.

The value of a window at a query time is then a running total of entries minus
exits, so no (query, event) pair is ever formed and all windows come out of one
pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.plans.lineage import cut
from priorsight.plans.timegrid import DAY_US, has_instants, measure_widths, running_totals, with_lane


def window_totals(
    events: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    days: Sequence[int],
    widths: Sequence[int] | None = None,
    start: str | None = None,
    since: str | None = None,
    us: str = "us",
) -> DataFrame:
    """Queries with ``<measure>_<d>``: the measure summed over the events in the window.

    An event counts for a query of the same key at time t when ``start < t``
    and ``t - since < d`` days.  For plain events both are the event time; an
    event that spans two times gives the later one as ``start`` and the earlier
    one as ``since``.  Measures must be non-null integers or decimals, and no
    two query rows may be equal.
    """
    if start is None and since is None:
        return _totals_between(events, queries, keys, measures, days, widths, us)
    start, since = start or us, since or us
    events = events.dropna(subset=list(keys))
    if widths is None:
        widths = measure_widths([events.withColumn(us, F.col(start)), queries], keys, us)
    steps = ", ".join(
        [f"struct(`{start}` as us, 0 as d)", *[f"struct(`{since}` + {d * DAY_US - 1}L as us, {d} as d)" for d in days]]
    )
    lane = ["lane"] if has_instants(widths) else []
    swept = with_lane(events, widths, *events.columns).select(
        *keys, start, since, *lane, *[m.alias(name) for name, m in measures.items()], F.expr(f"explode(array({steps})) as step")
    )
    schema = swept.schema
    kinds = {name: schema[name].dataType.simpleString() for name in measures}
    sums = [f"{name}_{d}" for d in days for name in measures]
    changes = [
        f"cast(case when `{since}` + {d * DAY_US - 1}L <= `{start}` then 0 when step.d = 0 then `{name}` "
        f"when step.d = {d} then -`{name}` else 0 end as {kinds[name]}) as `{name}_{d}`"
        for d in days
        for name in measures
    ]
    deltas = swept.selectExpr(*[f"`{k}`" for k in keys], f"step.us as `{us}`", "1 as is_event", *lane, *changes)
    zeros = [f"cast(0 as {kinds[name]}) as `{name}_{d}`" for d in days for name in measures]
    return _swept(deltas, queries, zeros, keys, sums, widths, us)


def _totals_between(
    events: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    days: Sequence[int],
    widths: Sequence[int] | None,
    us: str,
) -> DataFrame:
    """Plain events: the total before the query minus the total up to the start of the window.

    Each event is one row and each query one row per window border, which is
    less than an entry and an exit per event and window.
    """
    events = events.dropna(subset=list(keys))
    if widths is None:
        widths = measure_widths([events, queries], keys, us)
    lane = ["lane"] if has_instants(widths) else []
    deltas = with_lane(events, widths, *events.columns).select(
        *keys, us, F.lit(1).alias("side"), *lane, *[m.alias(name) for name, m in measures.items()]
    )
    schema = deltas.schema
    zeros = [f"cast(0 as {schema[name].dataType.simpleString()}) as `{name}`" for name in measures]
    borders = ", ".join(
        [f"struct(`{us}` as at, 0 as side, 0 as d)", *[f"struct(`{us}` - {d * DAY_US}L as at, 2 as side, {d} as d)" for d in days]]
    )
    own = [f"`{c}` as `q_{c}`" for c in queries.columns]
    asked = (
        with_lane(queries, widths, *queries.columns)
        .selectExpr(*[f"`{k}`" for k in keys], *lane, *own, f"explode(array({borders})) as border")
        .selectExpr(
            *[f"`{k}`" for k in keys], *lane, *[f"`q_{c}`" for c in queries.columns],
            f"border.at as `{us}`", "border.side as side", "border.d as d", *zeros,
        )
    )
    rows = asked.unionByName(deltas, allowMissingColumns=True)
    totals = running_totals(rows, keys, list(measures), widths, us, ("side",)).filter("side <> 1")
    kinds = {name: schema[name].dataType.simpleString() for name in measures}
    differences = [
        F.expr(
            f"cast(sum(case when d = 0 then `run_{name}` when d = {d} then -`run_{name}` end) as {kinds[name]})"
        ).alias(f"{name}_{d}")
        for d in days
        for name in measures
    ]
    return totals.groupBy(*[F.col(f"q_{c}").alias(c) for c in queries.columns]).agg(*differences)


def totals_before(
    events: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    widths: Sequence[int] | None = None,
    us: str = "us",
) -> DataFrame:
    """Queries with each measure summed over all events of the key strictly before."""
    events = events.dropna(subset=list(keys))
    if widths is None:
        widths = measure_widths([events, queries], keys, us)
    lane = ["lane"] if has_instants(widths) else []
    deltas = with_lane(events, widths, *events.columns).select(
        *keys, us, F.lit(1).alias("is_event"), *lane, *[m.alias(name) for name, m in measures.items()]
    )
    schema = deltas.schema
    zeros = [f"cast(0 as {schema[name].dataType.simpleString()}) as `{name}`" for name in measures]
    return _swept(deltas, queries, zeros, keys, list(measures), widths, us)


def _swept(
    deltas: DataFrame, queries: DataFrame, zeros: Sequence[str], keys: Sequence[str], sums: Sequence[str],
    widths: Sequence[int], us: str,
) -> DataFrame:
    """Queries with the running totals of the changes that came strictly before them."""
    asked = with_lane(queries, widths, *queries.columns).selectExpr("*", "0 as is_event", *zeros)
    rows = asked.unionByName(deltas, allowMissingColumns=True)
    totals = running_totals(rows, keys, sums, widths, us, ("is_event",))
    return totals.filter("is_event = 0").selectExpr(
        *[f"`{c}`" for c in queries.columns], *[f"`run_{c}` as `{c}`" for c in sums]
    )


DIGIT_BITS = 4


def window_order_statistics(
    events: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    code: str,
    days: Sequence[int],
    widths: Sequence[int],
    start: str = "us",
    since: str = "us",
    us: str = "us",
) -> DataFrame:
    """The code at position ``pos`` (from 0) of the ordered codes in the window of ``d`` days.

    ``queries`` hold the keys, the time, ``d`` and ``pos``; ``code`` is a
    non-negative long.  The answer is found digit by digit from the top: each
    round counts, per query, the window's events by the next digit among those
    that share the digits found so far.  Exact for windows of any size, since a
    round is one running total per (key, digits found).
    """
    top = events.agg(F.max(code).alias("m")).first()["m"] or 0
    rounds = max(1, -(-int(top).bit_length() // DIGIT_BITS))
    base = 1 << DIGIT_BITS
    digits = [f"at_{i}" for i in range(base)]

    alive = F.col(since) + F.col("d") * DAY_US - 1
    lane = ["lane"] if has_instants(widths) else []
    deltas = (
        with_lane(events, widths, *events.columns).withColumn("d", F.explode(F.array(*[F.lit(d) for d in days])))
        .filter(alive > F.col(start))
        .withColumn(
            "step",
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("us"), F.lit(1).alias("by")),
                    F.struct(alive.alias("us"), F.lit(-1).alias("by")),
                )
            ),
        )
        .select(*keys, "d", F.col(code).cast("long").alias("code"), F.col("step.us").alias(us), F.col("step.by").alias("by"), *lane)
    )
    found = queries.withColumns({"found": F.lit(0).cast("long"), "left": F.col("pos").cast("long")})
    for i in range(rounds):
        shift = DIGIT_BITS * (rounds - 1 - i)
        digit = F.shiftright("code", shift).bitwiseAND(base - 1)
        # Nothing is found before the first round; a shift by 64 would be one by 0.
        known = F.shiftright("code", shift + DIGIT_BITS) if i else F.lit(0).cast("long")
        stepped = deltas.select(
            *keys, "d", us, known.alias("found"), F.lit(1).alias("is_event"), *lane,
            *[F.when(digit == j, F.col("by")).otherwise(0).cast("long").alias(c) for j, c in enumerate(digits)],
        )
        asked = with_lane(found, widths, *queries.columns).withColumns({"is_event": F.lit(0), **{c: F.lit(0).cast("long") for c in digits}})
        rows = asked.unionByName(stepped, allowMissingColumns=True)
        swept = running_totals(rows, [*keys, "d", "found"], digits, widths, us, ("is_event",))
        upto = [sum((F.col(f"run_{c}") for c in digits[: j + 1]), F.lit(0)) for j in range(base)]
        below = [F.lit(0).cast("long"), *upto[:-1]]
        pick = F.lit(base - 1)
        skip = below[-1]
        for j in reversed(range(base - 1)):
            pick = F.when(F.col("left") < upto[j], F.lit(j)).otherwise(pick)
            skip = F.when(F.col("left") < upto[j], below[j]).otherwise(skip)
        found = (
            swept.filter(F.col("is_event") == 0)
            .withColumns({"digit": pick, "skipped": skip})
            .withColumns({"found": F.col("found") * base + F.col("digit"), "left": F.col("left") - F.col("skipped")})
            .select(*queries.columns, "found", "left")
        )
        # Each round builds on the last; without a cut the plan would double per round.
        found = cut(found)
    return found.select(*queries.columns, F.col("found").alias("code"))
