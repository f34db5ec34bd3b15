"""Repeatable samples and splits: every draw is a hash of the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.functions.scalars import hashed_unit
from priorsight.plans.ordering import attach_row, with_global_order


def nth_part(df: DataFrame, parts: int, key: str, salt: str = "", name: str = "part") -> DataFrame:
    """Shuffle by key hash and cut into ``parts`` equal parts, numbered from 1."""
    drawn = df.withColumn("draw", hashed_unit(F.col(key), salt))
    ordered = with_global_order(drawn, ["draw", key])
    return ordered.withColumn(name, F.ceil(F.col("position") * parts / F.col("n_rows")).cast("int")).drop(
        "draw", "position", "n_rows"
    )


def certain_part(df: DataFrame, order: Sequence[str], numerator: int, denominator: int) -> DataFrame:
    """The n-th of m equal parts of the rows in the given order."""
    ordered = with_global_order(df, order)
    low = F.floor(F.col("n_rows") * (numerator - 1) / denominator)
    high = F.floor(F.col("n_rows") * numerator / denominator)
    return ordered.filter((F.col("position") > low) & (F.col("position") <= high)).drop("position", "n_rows")


def temporal_folds(
    df: DataFrame, period: Column, folds: Sequence[tuple[tuple[int, int], int]], key: str, parts: int = 3
) -> DataFrame:
    """Training periods against a later validation period, each shuffled and cut in parts.

    ``folds`` hold ((first, last) training period, validation period).  Returns
    the key with ``fold`` (from 0) and ``role``; part i of a training period
    meets part i of its validation period.
    """
    chosen = []
    for i, ((first, last), validation) in enumerate(folds):
        for role, inside in (("train", F.col("period").between(first, last)), ("validation", F.col("period") == validation)):
            draw = hashed_unit(F.col(key), f"{role}{i}")
            chosen.append(F.when(inside, F.struct(F.lit(i).alias("number"), F.lit(role).alias("role"), draw.alias("draw"))))
    rows = df.select(key, period.alias("period")).select(key, F.explode(F.array_compact(F.array(*chosen))).alias("m")).select(key, "m.*")
    # One order for all folds and roles; a row for each of them tells where it begins.
    ordered = with_global_order(rows, ["number", "role", "draw", key])
    groups = ordered.groupBy("number", "role").agg((F.min("position") - 1).alias("before"), F.count(F.lit(1)).alias("size"))
    part = F.ceil((F.col("position") - F.col("before")) * parts / F.col("size")).cast("int")
    return ordered.join(F.broadcast(groups), ["number", "role"]).select(key, ((part - 1) * len(folds) + F.col("number")).alias("fold"), "role")


def shuffled_folds(df: DataFrame, key: str, k: int = 5, salt: str = "fold") -> DataFrame:
    return df.withColumn("fold", F.floor(hashed_unit(F.col(key), salt) * k).cast("int"))


def random_split(df: DataFrame, key: str, share: float = 0.8, salt: str = "split") -> tuple[DataFrame, DataFrame]:
    first = hashed_unit(F.col(key), salt) < share
    return df.filter(first), df.filter(~first)


def rebalanced(df: DataFrame, label: str, key: str, copies: int = 2, ratio: int = 4, salt: str = "resample") -> DataFrame:
    """Positives ``copies`` times, and ``ratio`` negatives per positive drawn with replacement.

    Draw i takes the negative at a hashed position, so the draws are joined to
    numbered negatives and neither side is collected.  Adds ``draw``, which
    numbers the copies of one row.
    """
    positives = df.filter(F.col(label) == 1)
    negatives = with_global_order(df.filter(F.col(label) == 0), [key])
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    draws = df.sparkSession.range(ratio * sizes["p"]).select(
        F.col("id").alias("draw"),
        (F.floor(hashed_unit(F.col("id"), salt) * sizes["n"]) + 1).alias("position"),
    )
    drawn = draws.join(negatives, "position").select(*df.columns, "draw")
    copy_numbers = F.array(*[F.lit(i).cast("long") for i in range(copies)])
    doubled = positives.withColumn("draw", F.explode(copy_numbers))
    return doubled.select(*df.columns, "draw").unionByName(drawn)


def undersampled(df: DataFrame, label: str, key: str, salt: str = "under") -> DataFrame:
    """All positives and as many negatives, those with the smallest key hash."""
    positives = df.filter(F.col(label) == 1)
    wanted = positives.count()
    drawn = df.filter(F.col(label) == 0).withColumn("draw", hashed_unit(F.col(key), salt))
    kept = with_global_order(drawn, ["draw", key]).filter(F.col("position") <= wanted)
    return positives.unionByName(kept.select(*df.columns))


def class_weights(df: DataFrame, label: str, positive: float | None = None, name: str = "weight") -> DataFrame:
    """A weight per row: ``positive`` to 1, or, if not given, inversely to the class sizes."""
    if positive is not None:
        return df.withColumn(name, F.when(F.col(label) == 1, float(positive)).otherwise(1.0))
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    both = F.col("p") + F.col("n")
    weight = F.when(F.col(label) == 1, F.try_divide(both, 2 * F.col("p"))).otherwise(F.try_divide(both, 2 * F.col("n")))
    return attach_row(df, sizes).withColumn(name, weight).drop("p", "n")
