"""One row per user: aggregates over all of a user's logins, and their join with the trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_users(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key).distinct()


def whole_second_counts(timelong: Column) -> list[Column]:
    whole = timelong % 1000 == 0
    return [F.count_if(whole).alias("whole_second"), F.count_if(~whole).alias("broken_second")]


def distinct_counts(columns: Sequence[str]) -> list[Column]:
    return [F.count_distinct(c).alias(f"{c}_Counts") for c in columns]


#: Sketches have 2^12 registers: 4 kB at most, and a relative error of about 1.04 / 2^6 = 1.6 %.
SKETCH_BITS = 12


def daily_sketches(log: DataFrame, columns: Sequence[str], key: str = "id", time: str = "time", bits: int = SKETCH_BITS) -> DataFrame:
    """Per key and day, a mergeable sketch of the distinct values of each column; nulls are no values."""
    return log.groupBy(key, F.to_date(time).alias("day")).agg(*[F.hll_sketch_agg(c, bits).alias(c) for c in columns])


def rolled_up(sketches: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Approximate distinct counts per key over the days of ``sketches``; any period is a filter on ``day``, without the log."""
    return sketches.groupBy(key).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"{c}_Counts") for c in columns])


def spread(column: str, which: Sequence[str] = ("Mean", "min", "max", "var", "std")) -> list[Column]:
    """Mean, extremes, and sample variance and deviation of a column."""
    functions = {"Mean": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "std": F.stddev_samp}
    return [functions[w](column).alias(f"{column}_{w}") for w in which]


def other_results(result: str = "result") -> Column:
    """How many logins did not end with code 1."""
    return F.count_if(F.col(result) != 1).alias("result_no1_Counts")


def user_table(
    logins: DataFrame, counted: Sequence[str] = ("device", "ip", "log_from", "type", "city", "log_id"), key: str = "id"
) -> DataFrame:
    """All user aggregates in one pass; only users with some result other than 1 are kept."""
    return (
        logins.groupBy(key)
        .agg(*whole_second_counts(F.col("timelong")), *spread("timelong", ("min", "max", "Mean", "std")), *distinct_counts(counted), other_results())
        .filter(F.col("result_no1_Counts") > 0)
    )


def value_share(logins: DataFrame, column: str, key: str = "id", login_key: str = "log_id") -> DataFrame:
    """Per login, the share of the user's logins that have its value of ``column``."""
    per_value = logins.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    # The per-user total adds up the per-value counts, so the log is read once.
    per_user = per_value.groupBy(key).agg(F.sum("n").alias("total"))
    shares = per_value.join(per_user, key).select(key, column, (F.col("n") / F.col("total")).alias(f"{column}_scale"))
    return logins.select(login_key, key, column).join(shares, [key, column]).select(login_key, f"{column}_scale")


def trade_login_features(
    trades: DataFrame, logins: DataFrame, shares: Sequence[str] = ("device", "city"), link: str = "login_id"
) -> DataFrame:
    """Hour of the trade, seconds within the day since its login, and value shares of that login."""
    times = logins.select(F.col("log_id").alias(link), F.col("time").alias("login_time"))
    seconds = F.unix_seconds("time") - F.unix_seconds("login_time")
    out = trades.join(times, link).withColumns(
        {"hours": F.hour("time"), "st": F.pmod(seconds, F.lit(86_400))}
    ).drop("login_time")
    for c in shares:
        out = out.join(value_share(logins, c).withColumnRenamed("log_id", link), link)
    return out


def users_with_trades(users: DataFrame, trades: DataFrame, key: str = "id") -> DataFrame:
    return users.join(trades, key)


def scores_for_all(trades: DataFrame, scores: DataFrame, key: str = "rowkey", score: str = "is_risk") -> DataFrame:
    """Every trade with its score, 0 where it has none."""
    return trades.select(key).join(scores.select(key, score), key, "left").withColumn(score, F.coalesce(score, F.lit(0)))
