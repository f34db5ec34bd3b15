"""Profiles of tables: counts, overlaps, distributions, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.functions.scalars import MISSING
from priorsight.plans.lineage import cut
from priorsight.plans.ordering import attach_row, with_global_order

#: More groups than this meet their rows by a shuffle.
BROADCAST_GROUPS = 100_000


def n_rows() -> Column:
    return F.count(F.lit(1))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(n_rows().alias("n"))


def with_share(counts: DataFrame, count: str = "n", share: str = "share") -> DataFrame:
    """Adds each row's part of the total; ``counts`` is an aggregate and is summed as such."""
    total = counts.agg(F.sum(count).alias("all_n"))
    return attach_row(counts, total).withColumn(share, F.col(count) / F.col("all_n")).drop("all_n")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sets, of either, of both together, and of one only, in one row."""
    sides = (
        a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
        .groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    ina, inb = F.col("in_a") == 1, F.col("in_b") == 1
    return sides.agg(
        F.count_if(ina).alias("keys_a"), F.count_if(inb).alias("keys_b"), n_rows().alias("keys_any"),
        F.count_if(ina & ~inb).alias("only_a"), F.count_if(~ina & inb).alias("only_b"), F.count_if(ina & inb).alias("in_both"),
    )


def quantiles(df: DataFrame, column: str, qs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles, one row (per group) with a column for each name.

    Equal values are counted before anything is sorted, and the sort is a range
    partitioning of the whole table, so neither a frequent value nor a large
    group ends up in one task.
    """
    by = list(by)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("x")).agg(n_rows().alias("n"))
    ordered = with_global_order(counts, [*by, "x"], ["n"])
    if by:
        groups = cut(ordered.groupBy(*by).agg(F.sum("n").alias("size"), F.min(F.col("run_n") - F.col("n")).alias("before")))
        # A large group is not shuffled to its one row while there are few groups.
        few = groups.count() <= BROADCAST_GROUPS
        joined = ordered.join(F.broadcast(groups) if few else groups, by)
    else:
        joined = ordered.withColumns({"size": F.col("all_n"), "before": F.lit(0)})
    first = F.col("run_n") - F.col("n") - F.col("before")
    last = F.col("run_n") - F.col("before") - 1
    picks = []
    for name, q in qs.items():
        place = F.lit(q) * (F.col("size") - 1)
        low, high = F.floor(place), F.ceil(place)
        at = lambda p: F.max(F.when((first <= p) & (p <= last), F.col("x").cast("double")))
        picks += [at(low).alias(f"lo_{name}"), at(high).alias(f"hi_{name}"), F.max(place - low).alias(f"w_{name}")]
    picked = joined.groupBy(*by).agg(*picks)
    return picked.select(
        *by,
        *[(F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * F.col(f"w_{n}")).alias(n) for n in qs],
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], qs: Mapping[str, float]) -> dict[str, dict[str, float | None]]:
    """The quantiles of every column, by one order over the values of all of them; null where a column has no values."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]))
    found = quantiles(df.select(values.alias("v")).select("v.*"), "x", qs, ["feature"]).collect()  # one row a column
    by = {r["feature"]: {name: r[name] for name in qs} for r in found}
    return {c: by.get(c, dict.fromkeys(qs)) for c in columns}


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a column, in one row."""
    parts = quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    moments = df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("low"), F.max(column).alias("high"),
    )
    return attach_row(moments, parts)


def histogram(df: DataFrame, column: str, bins: int = 10, below_quantile: float | None = None) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value, the last bin closed.

    ``below_quantile`` first drops all values from that quantile on.
    """
    data = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    if below_quantile is not None:
        edge = quantiles(data, "x", {"edge": below_quantile})
        data = attach_row(data, edge).filter("x < edge").select("x")
    ends = data.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), width)), F.lit(bins - 1)))
    placed = attach_row(data, ends).select(place.cast("int").alias("bin"), "low", width.alias("width"))
    return placed.groupBy("bin").agg(
        n_rows().alias("n"), F.min(F.col("low") + F.col("bin") * F.col("width")).alias("from_value"),
        F.min(F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("to_value"),
    )


def histogram_mean(bins: DataFrame) -> DataFrame:
    """Mean of the bin middles weighted by the bin counts."""
    middle = (F.col("from_value") + F.col("to_value")) / 2
    return bins.agg((F.sum(middle * F.col("n")) / F.sum("n")).alias("mean"))


def pareto(df: DataFrame, key: str) -> DataFrame:
    """Keys from the most to the least frequent, with cumulative count and share."""
    counts = value_counts(df, key)
    ordered = with_global_order(counts, [F.desc("n"), F.col(key)], ["n"])
    return ordered.select(
        key, "n", "position", F.col("run_n").alias("cumulative"), (F.col("run_n") / F.col("all_n")).alias("share")
    )


def risk_per_key(df: DataFrame, key: str, label: str) -> DataFrame:
    counted = df.groupBy(key).agg(n_rows().alias("trades"), F.count_if(F.col(label) == 1).alias("risky"))
    return counted.withColumn("portion", F.col("risky") / F.col("trades"))


def label_odds(df: DataFrame, bucket: Column, label: str, positive_over_negative: bool = True) -> DataFrame:
    """Counts per label in each bucket, and their ratio one way or the other."""
    counted = df.groupBy(bucket.alias("bucket")).pivot(label, [0, 1]).agg(n_rows())
    zero, one = F.coalesce(F.col("0"), F.lit(0)), F.coalesce(F.col("1"), F.lit(0))
    ratio = F.try_divide(one, zero) if positive_over_negative else F.try_divide(zero, one)
    return counted.select("bucket", zero.alias("negatives"), one.alias("positives"), ratio.alias("odds"))


def duplication(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(n_rows().alias("n")).agg(F.sum("n").alias("rows"), n_rows().alias("keys"))


def attribute_cardinality(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """How many different ``b`` an ``a`` has; ``excess`` is 0 where ``a`` determines ``b``."""
    per_a = df.select(*a, *b).distinct().groupBy(*a).agg(n_rows().alias("n"))
    return per_a.agg(
        n_rows().alias("keys"), F.sum("n").alias("pairs"), (F.sum("n") - n_rows()).alias("excess"),
        F.max("n").alias("most"), F.avg("n").alias("mean"),
    )


def unpivoted(df: DataFrame, measures: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One aggregation over the table, turned into one row per column: ``measures[column][name]``."""
    flat = {f"m{i}_{n}": c for i, (_, ms) in enumerate(measures.items()) for n, c in ms.items()}
    one_row = df.agg(*[c.alias(n) for n, c in flat.items()])
    rows = [
        F.struct(F.lit(col).alias("column"), *[F.col(f"m{i}_{n}").alias(n) for n in ms])
        for i, (col, ms) in enumerate(measures.items())
    ]
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def completeness(df: DataFrame, columns: Sequence[str], marker: int = MISSING) -> DataFrame:
    """Per column the share of marked and the number of null values."""
    return unpivoted(
        df,
        {
            c: {
                "emptiness": F.avg(F.coalesce((F.col(c) == marker).cast("double"), F.lit(0.0))),
                "nulls": F.count_if(F.col(c).isNull()),
            }
            for c in columns
        },
    )


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the number of NaN, infinite and negative infinite values."""
    x = {c: F.col(c).cast("double") for c in columns}
    return unpivoted(
        df,
        {
            c: {
                "nans": F.count_if(F.isnan(v)),
                "infinite": F.count_if(v == float("inf")),
                "minus_infinite": F.count_if(v == float("-inf")),
            }
            for c, v in x.items()
        },
    )


def column_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column its type and its number of distinct non-null values."""
    types = dict(df.dtypes)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.*").distinct()
    counted = long.groupBy("column").agg(F.count("v").alias("distinct_values"))
    named = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return counted.withColumn("type", named[F.col("column")])
