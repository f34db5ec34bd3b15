"""Details of a trade's latest logins: comparisons, gaps, and gaps filled in where logins are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.operators.families import _with_following
from priorsight.plans.timegrid import measure_widths
from priorsight.plans.windows import totals_before

COMPARED = ("device", "ip", "city", "log_from", "result", "type")


def recent_details(linked: DataFrame, details: Sequence[str], k: int = 3) -> DataFrame:
    """The details of each linked login as ``<detail>_login_<i>``, and how many there are."""
    number = sum((F.col(f"last_{i}").isNotNull().cast("int") for i in range(1, k)), F.col("last_0").isNotNull().cast("int"))
    return linked.select(
        "*",
        *[F.col(f"last_{i}.{c}").alias(f"{c}_login_{i}") for i in range(k) for c in details],
        number.alias("recent_login_number"),
    )


def comparison_flags(detailed: DataFrame, compared: Sequence[str] = COMPARED) -> DataFrame:
    """1 where the latest login agrees with the second or third latest; missing ones never agree."""
    return detailed.withColumns(
        {
            f"{c}_comparing_login_{i}": F.coalesce(F.col(f"{c}_login_0") == F.col(f"{c}_login_{i}"), F.lit(False)).cast("int")
            for c in compared
            for i in (1, 2)
        }
    )


def login_gaps(linked: DataFrame, us: str = "us", k: int = 3) -> DataFrame:
    """``login_distance_<i>``: seconds from the i-th latest login to the trade."""
    return linked.withColumns({f"login_distance_{i}": (F.col(us) - F.col(f"last_{i}.us")) / 1e6 for i in range(k)})


def gap_change(df: DataFrame) -> DataFrame:
    """Second difference of the three gaps."""
    d0, d1, d2 = (F.col(f"login_distance_{i}") for i in range(3))
    return df.withColumn("login_distance_diff", F.abs(d2 + d0 - 2 * d1))


def mean_login_gap(logins: DataFrame, users: DataFrame, start_us: int, end_us: int, key: str = "id") -> DataFrame:
    """``mean_login_distance`` in seconds between a user's logins over the whole period.

    With one login it is the shorter distance to an end of the period, with
    none the whole period.  Later logins count too; ``mean_gap_before`` looks
    at the past only.
    """
    spans = logins.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last")
    )
    mean = (
        F.when(F.col("n") >= 2, F.try_divide((F.col("last") - F.col("first")).cast("double"), F.col("n") - 1))
        .when(F.col("n") == 1, F.least(F.lit(end_us) - F.col("first"), F.col("first") - F.lit(start_us)).cast("double"))
        .otherwise(F.lit(float(end_us - start_us)))
    )
    return users.select(key).distinct().join(spans, key, "left").select(key, (mean / 1e6).alias("mean_login_distance"))


def mean_gap_before(logins: DataFrame, trades: DataFrame, key: str = "id", order: str = "log_id") -> DataFrame:
    """Mean seconds between a user's logins strictly before the trade; null for fewer than two."""
    widths = measure_widths([logins, trades], [key])
    pairs = _with_following(logins, key, order, widths).select(
        key, F.col("next_us").alias("us"), order, (F.col("next_us") - F.col("us")).alias("gap")
    )
    totals = totals_before(
        pairs, trades.select("rowkey", key, "us"), [key],
        {"gaps": F.col("gap"), "pairs": F.lit(1).cast("long")}, widths,
    )
    return totals.select("rowkey", (F.try_divide(F.col("gaps").cast("double"), F.col("pairs")) / 1e6).alias("mean_gap_before"))


def fill_gaps(df: DataFrame, start_us: int, us: str = "us", mean: str = "mean_login_distance") -> DataFrame:
    """``login_distance_<i>_al``: log gaps, with missing ones built up from the mean gap.

    The first missing gap is the mean gap on top of the one before it, or the
    time since the start of the period if that is longer; later ones add the
    mean gap each.
    """
    since_start = (F.col(us) - F.lit(start_us)) / 1e6
    m = F.col(mean)
    filled: list[Column] = []
    for i in range(3):
        gap = F.col(f"login_distance_{i}")
        if i == 0:
            first_missing = F.greatest(m, since_start)
            filled.append(F.coalesce(gap, first_missing))
            continue
        before_missing = F.col(f"login_distance_{i - 1}").isNull()
        first_missing = F.greatest(m + F.col(f"login_distance_{i - 1}"), since_start)
        filled.append(F.when(before_missing, filled[i - 1] + m).otherwise(F.coalesce(gap, first_missing)))
    return df.withColumns({f"login_distance_{i}_al": F.ln(x) for i, x in enumerate(filled)})
