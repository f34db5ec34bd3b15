"""Encodings of category values that use only what was known before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.functions.scalars import RARE, hashed_uniform
from priorsight.plans.timegrid import measure_widths
from priorsight.plans.windows import totals_before


def past_target_encoding(
    trades: DataFrame, keys: Mapping[str, Column], label: str = "is_risk", us: str = "us", rowkey: str = "rowkey"
) -> DataFrame:
    """``<key>_t_encoding``: mean label of the earlier rows with the same key value, 0 without any.

    All keys go through one pass, each row once per key.  Null key values match
    nothing, and rows at the same time do not see each other.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in keys.items()]))
    rows = trades.select(rowkey, us, label, pairs.alias("k")).select(rowkey, us, label, "k.*").filter(F.col("value").isNotNull())
    by = ["name", "value"]
    known = F.col(label).isNotNull()
    totals = totals_before(
        rows, rows.select(rowkey, us, *by), by,
        {"labels": F.coalesce(F.col(label).cast("long"), F.lit(0)).cast("long"), "known": known.cast("long")},
        measure_widths(rows, by, us), us,
    )
    mean = F.coalesce(F.try_divide(F.col("labels").cast("double"), F.col("known")), F.lit(0.0))
    wide = totals.withColumn("mean", mean).groupBy(rowkey).agg(
        *[F.max(F.when(F.col("name") == n, F.col("mean"))).alias(f"{n}_t_encoding") for n in keys]
    )
    return trades.select(rowkey).join(wide, rowkey, "left").select(
        rowkey, *[F.coalesce(f"{n}_t_encoding", F.lit(0.0)).alias(f"{n}_t_encoding") for n in keys]
    )


def with_noise(df: DataFrame, columns: Sequence[str], key: str = "rowkey", share: float = 0.1, salt: str = "noise") -> DataFrame:
    """Each column times one factor per row from ``1 - share`` to ``1 + share``."""
    factor = hashed_uniform(F.col(key), 1 - share, 1 + share, salt)
    return df.withColumns({c: F.col(c) * factor for c in columns})


def collapse_rare(df: DataFrame, column: str, least: int, marker=RARE) -> DataFrame:
    """Values seen fewer than ``least`` times become ``marker``; adds ``<column>_kept``."""
    rare = (
        df.filter(F.col(column).isNotNull()).groupBy(column).count().filter(F.col("count") < least)
        .select(column, F.lit(True).alias("is_rare"))
    )
    return (
        df.join(rare, column, "left")
        .withColumn(f"{column}_kept", F.when(F.col("is_rare"), F.lit(marker)).otherwise(F.col(column)))
        .drop("is_rare")
    )
