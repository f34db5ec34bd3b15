"""Statistics, binning, imputation, normalisation and outlier flags of features.

Functions that need a statistic of the whole table first fit it in one
aggregation and then put it into the plan as a constant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.operators.profile import column_quantiles, quantiles
from priorsight.plans.ordering import attach_row, with_global_order

FEW_VALUES = 20


def equal_count_bins(df: DataFrame, column: str, key: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Bins of equal size by sorted position; equal values are told apart by ``key``."""
    ordered = with_global_order(df, [column, key])
    place = F.ceil(F.col("position") * bins / F.col("n_rows")) - 1
    return ordered.withColumn(name, place.cast("int")).drop("position", "n_rows")


def quantile_edge_bins(df: DataFrame, column: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Bins between evenly spaced quantiles, each closed below, the last one on both sides."""
    edges = quantiles(df, column, {f"edge_{i}": i / bins for i in range(1, bins)})
    names = edges.columns
    row = edges.first()
    place = sum(((F.col(column) >= row[n]).cast("int") for n in names[1:]), (F.col(column) >= row[names[0]]).cast("int"))
    return df.withColumn(name, place)


def chi_square_categories(df: DataFrame, column: str, label: str, key: str) -> DataFrame:
    """``category`` and ``label``: the values themselves if they are few, else ten equal-count bins; null is no category."""
    df = df.filter(F.col(column).isNotNull())
    few = df.select(column).distinct().limit(FEW_VALUES).count() < FEW_VALUES
    data = df.select(key, F.col(column).alias("x"), F.col(label).alias("label"))
    if few:
        return data.select(F.col("x").cast("double").alias("category"), "label")
    return equal_count_bins(data, "x", key, name="category").select(F.col("category").cast("double").alias("category"), "label")


def chi_square(df: DataFrame, column: str, label: str, key: str) -> DataFrame:
    """Chi-square statistic of a feature against a 0/1 label, with Yates' correction for two categories."""
    table = (
        chi_square_categories(df, column, label, key)
        .groupBy("category")
        .agg(F.count_if(F.col("label") == 0).alias("o0"), F.count_if(F.col("label") == 1).alias("o1"))
    )
    totals = table.agg(F.sum("o0").alias("all0"), F.sum("o1").alias("all1"), F.count(F.lit(1)).alias("categories"))
    cells = attach_row(table, totals)
    row, n = F.col("o0") + F.col("o1"), F.col("all0") + F.col("all1")

    def part(o: str, total: str) -> Column:
        expected = row * F.col(total) / n
        off = F.abs(F.col(o) - expected)
        corrected = F.when(F.col("categories") == 2, off - F.least(off, F.lit(0.5))).otherwise(off)
        return F.when(expected > 0, corrected * corrected / expected).otherwise(0.0)

    return cells.agg(
        F.lit(column).alias("feature"),
        F.sum(part("o0", "all0") + part("o1", "all1")).alias("chi2"),
        (F.max("categories") - 1).alias("degrees"),
    )


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability of a chi-square above ``x``, by the finite sums for whole degrees of freedom."""
    if degrees < 1 or x <= 0:
        return 1.0
    half = x / 2
    if degrees % 2:
        tail, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        steps = [(1.5 + i) for i in range((degrees - 1) // 2)]
    else:
        tail, term = 0.0, math.exp(-half)
        steps = [(1.0 + i) for i in range(degrees // 2)]
    for k in steps:
        tail += term
        term *= half / k
    return tail


def chi_square_p_values(df: DataFrame, columns: Sequence[str], label: str, key: str) -> DataFrame:
    """``feature, chi2, degrees, p``: the corrected statistic and its own p-value; one row for each column."""
    rows = [chi_square(df, c, label, key).first() for c in columns]
    tested = [(r["feature"], r["chi2"], r["degrees"], chi_square_tail(r["chi2"] or 0.0, r["degrees"] or 0)) for r in rows]
    return df.sparkSession.createDataFrame(tested, "feature string, chi2 double, degrees long, p double")


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D'Agostino's K-squared test per column: ``k2`` and its p-value."""
    moments = df.agg(
        *[
            F.struct(F.lit(c).alias("feature"), F.count(c).cast("double").alias("n"), F.skewness(c).alias("g1"), (F.kurtosis(c) + 3).alias("b2")).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
    ).select(F.explode(F.array(*[f"m{i}" for i in range(len(columns))])).alias("m")).select("m.*")
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")

    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))

    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - expected) / F.sqrt(variance)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    below = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(below) * F.pow((1 - 2 / a) / F.abs(below), F.lit(1 / 3))
    z_kurtosis = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))

    k2 = z_skew * z_skew + z_kurtosis * z_kurtosis
    return moments.select("feature", k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def impute_median(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Nulls become the median of the column among the rows it is fitted on."""
    source = df if fitted_on is None else fitted_on
    medians = column_quantiles(source, columns, {"median": 0.5})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]["median"]).cast("double")) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    means = (df if fitted_on is None else fitted_on).agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")) for c in columns})


def shift_positive(df: DataFrame, column: str) -> DataFrame:
    """Add ``|min| + 1`` to a column that has values of zero or below."""
    low = df.agg(F.min(column).alias("low")).first()["low"]
    shift = abs(low) + 1 if low is not None and low <= 0 else 0
    return df.withColumn(column, F.col(column) + F.lit(float(shift)))


def _box_cox(x: Column, power: float) -> Column:
    return F.ln(x) if abs(power) < 1e-12 else (F.pow(x, F.lit(power)) - 1) / power


def fit_box_cox(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, steps: int = 20, rounds: int = 4) -> float:
    """The power of greatest likelihood; each round is one aggregation over a grid of powers."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        powers = [low + (high - low) * i / steps for i in range(steps + 1)]
        row = df.agg(
            F.count(x).alias("n"), F.sum(F.ln(x)).alias("logs"),
            *[F.var_pop(_box_cox(x, p)).alias(f"v{i}") for i, p in enumerate(powers)],
        ).first()

        def likelihood(i: int) -> float:
            v = row[f"v{i}"]
            return (powers[i] - 1) * row["logs"] - row["n"] / 2 * math.log(v) if v and v > 0 else -math.inf

        best = max(range(steps + 1), key=likelihood)
        step = (high - low) / steps
        low, high = powers[best] - step, powers[best] + step
    return (low + high) / 2


def box_cox(df: DataFrame, column: str, power: float) -> DataFrame:
    return df.withColumn(column, _box_cox(F.col(column).cast("double"), power))


def z_score(df: DataFrame, column: str) -> DataFrame:
    stats = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).first()
    return df.withColumn(column, F.try_divide(F.col(column) - F.lit(stats["mean"]), F.lit(stats["std"])))


def unit_norm(df: DataFrame, column: str) -> DataFrame:
    """The column over its Euclidean length."""
    length = math.sqrt(df.agg(F.sum(F.col(column) * F.col(column)).alias("s")).first()["s"] or 0.0)
    return df.withColumn(column, F.try_divide(F.col(column), F.lit(length)))


def row_unit_norm(df: DataFrame, column: str) -> DataFrame:
    """Each value over its own length, which leaves the sign."""
    return df.withColumn(column, F.signum(column))


def one_hot(df: DataFrame, column: str, most: int = 1_000) -> DataFrame:
    """One 0/1 column for every value that occurs, named ``<column>_<value>``.

    Every value becomes a column of the plan; a caller who wants more than ``most`` of them says so.
    """
    seen = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(seen) > most:
        raise ValueError(f"{column} has more than {most} values; allow more with most=")
    flags = {f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in sorted(seen)}
    return df.withColumns(flags)


def repair_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans with gaps as 0/1, a gap counting as false."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in columns})


def _outside(x: Column, middle: tuple[float | None, float | None], reach: float | None) -> Column:
    """1 more than ``reach`` above the upper, -1 below the lower of ``middle``, else 0; 0 where nothing was fitted."""
    if reach is None or None in middle:
        return F.lit(0)
    lower, upper = middle[0] - reach, middle[1] + reach
    return F.when(x > F.lit(upper), 1).when(x < F.lit(lower), -1).otherwise(0)


def three_sigma(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_3sigma``: 1 above, -1 below three sample deviations around the mean, else 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"std_{i}") for i, c in enumerate(columns)],
    ).first()
    reach = [None if stats[f"std_{i}"] is None else 3 * stats[f"std_{i}"] for i in range(len(columns))]
    return df.withColumns({f"{c}_3sigma": _outside(F.col(c), (stats[f"mean_{i}"],) * 2, reach[i]) for i, c in enumerate(columns)})


# The quantiles behind the flags as they have been computed so
# far (0.75 and 0.25 per cent), and the usual quartiles.
NARROW_QUANTILES = (0.0025, 0.0075)
QUARTILES = (0.25, 0.75)


def tukey(df: DataFrame, columns: Sequence[str], q: tuple[float, float] = NARROW_QUANTILES) -> DataFrame:
    """``<c>_tukey``: 1 above, -1 below the fences 1.5 quantile ranges outside the two quantiles, else 0."""
    flags = {}
    fences = column_quantiles(df, columns, {"low": q[0], "high": q[1]})
    for c in columns:
        low, high = fences[c]["low"], fences[c]["high"]
        flags[f"{c}_tukey"] = _outside(F.col(c), (low, high), None if low is None else 1.5 * (high - low))
    return df.withColumns(flags)


def principal_components(df: DataFrame, columns: Sequence[str], key: str, k: int) -> tuple[DataFrame, list[float]]:
    """Whitened components ``pc_0 ..`` per key, and the share of variance each explains."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    scored = model.transform(vectors).select(key, vector_to_array("pcs").alias("pcs"))
    parts = scored.select(key, *[F.col("pcs")[i].alias(f"pc_{i}") for i in range(k)])
    # MLlib projects without centring; the mean and deviation of a projection centre and whiten it.
    stats = parts.agg(
        *[F.avg(f"pc_{i}").alias(f"mean_{i}") for i in range(k)], *[F.stddev_samp(f"pc_{i}").alias(f"std_{i}") for i in range(k)]
    ).first()
    white = parts.select(
        key, *[F.try_divide(F.col(f"pc_{i}") - F.lit(stats[f"mean_{i}"]), F.lit(stats[f"std_{i}"])).alias(f"pc_{i}") for i in range(k)]
    )
    return white, [float(v) for v in model.explainedVariance.toArray()]
