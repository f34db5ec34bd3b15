"""Statistics of category values in trailing windows: distinct values, top count, rank of one value.

Counting the values of a window per query would list the window once per
query.  Instead every event raises the count of its value by one when it enters
and lowers it when it leaves, and each such change is a crossing of one count
level.  The number of values at or above a level, the number of levels in use
(which is the count of the most frequent value) and the number of distinct
values are then plain running totals of crossings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorsight.functions.scalars import rate
from priorsight.operators.history import linked_only, with_last_event
from priorsight.plans.lineage import cut
from priorsight.plans.timegrid import DAY_US, has_instants, measure_widths, running_totals, with_lane

MAX_LEVELS = 62  # node levels a long can number
STEP = 10  # levels of blocks that queries look at themselves; a join key then has 1,024 queries at most


def value_profile(
    events: DataFrame,
    queries: DataFrame,
    key: str,
    value: str,
    target: str,
    days: Sequence[int],
    least: bool = False,
    us: str = "us",
) -> DataFrame:
    """Per query and window: ``total, used, own, top, below`` (and ``least``) over the values seen.

    ``own`` is the count of the query's ``target`` value, ``top`` and ``least``
    the largest and smallest count of any value, ``used`` the number of
    different values with null as one of them, and ``below`` the number of
    values seen less often than the target.  Null values take part in ``total``
    and ``used`` only.  Returns ``rowkey, d`` and these columns.
    """
    widths = measure_widths([events, queries], [key], us)
    lane = ["lane"] if has_instants(widths) else []
    changes = F.explode(
        F.array(
            *[
                F.struct(at.alias("us"), F.lit(d).alias("d"), F.lit(by).cast("long").alias("by"))
                for d in days
                for at, by in ((F.col(us), 1), (F.col(us) + d * DAY_US - 1, -1))
            ]
        )
    )
    events = with_lane(events, widths, *events.columns).dropna(subset=[key])
    queries = with_lane(queries, widths, "rowkey")
    deltas = events.select(F.col(key).alias("key"), F.col(value).alias("value"), *lane, changes.alias("c")).select(
        "key", "value", *lane, "c.*", F.lit(1).alias("is_event"), F.lit(0).cast("long").alias("asked")
    )
    asked = queries.select(
        "rowkey", *lane, F.col(key).alias("key"), F.col(target).alias("value"), F.col(us).alias("us"),
        F.explode(F.array(*[F.lit(d) for d in days])).alias("d"),
        F.lit(0).cast("long").alias("by"), F.lit(0).alias("is_event"), F.lit(1).cast("long").alias("asked"),
    )
    rows = asked.unionByName(deltas, allowMissingColumns=True)
    order = ("is_event",)
    if least:
        rows = running_totals(rows, ["key", "d"], ["asked"], widths, tie=order).drop("asked").withColumnRenamed(
            "run_asked", "asked"
        )
    counted = running_totals(
        rows, ["key", "d", "value"], ["by"], widths, tie=order, ahead="asked" if least else None
    ).withColumnRenamed("run_by", "own")
    # Four further plans start from here.
    counted = cut(counted.withColumn("level", F.when(F.col("by") < 0, F.col("own") + 1).otherwise(F.col("own"))))

    # Null values live on levels of their own, below zero.
    leveled = counted.withColumn("level", F.when(F.col("value").isNull(), -F.col("level") - 1).otherwise(F.col("level")))
    held = running_totals(leveled, ["key", "d", "level"], ["by"], widths, tie=order).withColumnRenamed(
        "run_by", "at_level"
    )
    before = F.col("at_level") - F.col("by")
    real = F.col("value").isNotNull()
    switches = held.withColumns(
        {
            "first": F.when(real & (F.col("level") == 1), F.col("by")).otherwise(0).cast("long"),
            "blank": F.when(~real & (F.col("level") == -2), F.col("by")).otherwise(0).cast("long"),
            "opened": F.when(
                real & (F.col("level") > 0), (F.col("at_level") > 0).cast("long") - (before > 0).cast("long")
            ).otherwise(0).cast("long"),
        }
    )
    swept = running_totals(switches, ["key", "d"], ["by", "first", "blank", "opened"], widths, tie=order)
    own = F.when(real, F.col("own")).otherwise(0)
    out = swept.filter(F.col("is_event") == 0).select(
        "rowkey", "d",
        F.col("run_by").alias("total"),
        (F.col("run_first") + F.col("run_blank")).alias("used"),
        own.alias("own"),
        F.col("run_opened").alias("top"),
        F.when(own > 0, F.col("run_first") - F.col("at_level")).alias("below"),
    )
    if least:
        out = out.join(_least_counts(counted), ["rowkey", "d"], "left")
    return out


def _least_counts(counted: DataFrame) -> DataFrame:
    """Smallest count of any value in the window of each query.

    While a value keeps its count, it concerns the queries numbered from
    ``asked`` up to ``next_asked`` of its key.  Such a range of numbers is split
    into aligned blocks of powers of two; a query then only looks at the blocks
    its own number lies in, and each block keeps nothing but its minimum.  Large
    blocks are looked at once for many queries (``_lowest_over``).  A
    query row ends one such range of its target value and starts the next.
    """
    runs = counted.filter(
        F.col("value").isNotNull() & (F.col("own") > 0) & (F.col("next_asked") > F.col("asked"))
    ).select("key", "d", "own", F.col("asked").alias("a"), F.col("next_asked").alias("b"))
    longest = runs.agg(F.max(F.col("b") - F.col("a")).alias("m")).first()["m"] or 1
    levels = min(int(longest).bit_length(), MAX_LEVELS)

    blocks = []
    for j in range(levels):
        a = F.shiftright(F.col("a") + ((1 << j) - 1), j)
        b = F.shiftright(F.col("b"), j)
        node = lambda at: F.struct(F.lit(j).alias("j"), at.alias("block"))  # noqa: B023, E731
        blocks.append(F.when((a < b) & (a % 2 == 1), node(a)))
        blocks.append(F.when((a < b) & (b % 2 == 1), node(b - 1)))
        if j == levels - 1:
            # At the last level whatever is left, at most two blocks, is taken whole.
            blocks.append(F.when((a < b) & (a % 2 == 0), node(a)))
            blocks.append(F.when((a + 1 < b) & (b % 2 == 0), node(b - 1)))
    lows = (
        runs.select("key", "d", "own", F.explode(F.array_compact(F.array(*blocks))).alias("n"))
        .groupBy("key", "d", "n.j", "n.block")
        .agg(F.min("own").alias("own"))
    )
    looked = counted.filter(F.col("is_event") == 0).select("rowkey", "key", "d", (F.col("asked") - 1).alias("number"))
    return _lowest_over(looked, lows, levels, ["rowkey", "d"])


def _lowest_over(looked: DataFrame, lows: DataFrame, levels: int, ids: Sequence[str]) -> DataFrame:
    """``ids`` and ``least``: the smallest ``own`` of the blocks that hold each number, on any of ``levels`` levels.

    Numbers meet the blocks of the lowest STEP levels themselves.  What larger blocks hold is the same for all numbers of one
    group of ``2**STEP``, so that it is asked once a group, of the next levels, and handed down.  No join key has
    more numbers than a group, whatever share of them a key holds.
    """
    here = min(levels, STEP)
    blocks = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftright("number", j).alias("block")) for j in range(here)]))
    near = looked.select(*dict.fromkeys([*ids, "key", "d"]), blocks.alias("n")).select(*dict.fromkeys([*ids, "key", "d"]), "n.*")
    found = near.join(lows.filter(F.col("j") < here), ["key", "d", "j", "block"]).select(*ids, "own")
    if levels > STEP:
        group = F.shiftright("number", STEP)
        groups = looked.select("key", "d", group.alias("number")).distinct()
        higher = lows.filter(F.col("j") >= STEP).withColumn("j", F.col("j") - STEP)
        above = _lowest_over(groups, higher, levels - STEP, ["key", "d", "number"])
        handed = looked.withColumn("group", group).join(above.select("key", "d", F.col("number").alias("group"), F.col("least").alias("own")), ["key", "d", "group"])
        found = found.unionByName(handed.select(*ids, "own"))
    return found.groupBy(*ids).agg(F.min("own").alias("least"))


def _wide(profile: DataFrame, days: Sequence[int], features: dict, prefix: str) -> DataFrame:
    """One row per query: every feature of every window as its own column."""
    named = profile.select("rowkey", "d", *[c.alias(n) for n, c in features.items()])
    return named.groupBy("rowkey").agg(
        *[F.max(F.when(F.col("d") == d, F.col(n))).alias(f"{prefix}_{n}_{d}") for d in days for n in features]
    )


def repeat_statistics(
    logins: DataFrame, trades: DataFrame, category: str, days: Sequence[int], key: str = "id",
    order: str = "log_id", suffix: str = "",
) -> DataFrame:
    """How usual the latest login's value of ``category`` is in each window; null without logins."""
    asked = with_last_event(logins, trades.select("rowkey", key, "us"), {category: "target"}, (key,), order)
    profile = value_profile(logins, asked, key, category, "target", days, least=True)
    total, own, top = F.col("total"), F.col("own"), F.col("top")
    some = total > 0
    known = top > 0
    features = {
        "repeat_count": F.when(some, own),
        "repeat_rate": F.when(some, own / total),
        "used_count": F.when(some, F.col("used")),
        "freq_rank": F.when(some & (own > 0), F.col("below") + 1),
        "most_freq_count": F.when(known, top),
        "most_freq_rate": F.when(known, top / total),
        "max_min_dist": F.when(known, (top - F.col("least")) / top),
    }
    return _wide(profile, days, features, category + suffix)


def shared_value_profile(
    logins: DataFrame, trades: DataFrame, category: str, days: Sequence[int], key: str = "id",
    order: str = "log_id", suffix: str = "", history: DataFrame | None = None,
) -> DataFrame:
    """Who else used the value of the trade's latest login, such as its device.

    The value comes from the user's latest login in ``logins``; the logins of
    all users with that value are looked at in ``history`` (the same log by
    default).
    """
    history = logins if history is None else history
    asked = with_last_event(logins, trades.select("rowkey", key, "us"), {category: category}, (key,), order)
    seen = history.filter(F.col(category).isNotNull())
    profile = value_profile(seen, asked, category, key, key, days)
    total = F.col("total")
    features = {
        "login_count": total,
        "same_id_login_count": F.col("own"),
        "diff_id_counts": F.col("used"),
        "most_used_id_counts": F.col("top"),
        "same_id_login_rate": rate(F.col("own"), total),
        "most_used_id_rate": rate(F.col("top"), total),
    }
    return _wide(profile, days, features, category + suffix)


def linked_repeat_statistics(logins, links, trades, category, days, **names) -> DataFrame:
    """``repeat_statistics`` over the logins that were some trade's latest one; suffix ``_t``."""
    return repeat_statistics(linked_only(logins, links), trades, category, days, suffix="_t", **names)


def linked_value_profile(logins, links, trades, category, days, **names) -> DataFrame:
    """``shared_value_profile`` over the logins that were some trade's latest one; suffix ``_t``."""
    return shared_value_profile(
        logins, trades, category, days, suffix="_t", history=linked_only(logins, links), **names
    )
