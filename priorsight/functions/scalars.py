"""Scalar expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers used at the edge of the model matrix.
MISSING = -10
RARE = -5
NEGATIVE_DURATION = -1


def micros(time: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def parse_time(text: Column) -> Column:
    """Parse the first 19 characters, dropping any fraction of a second."""
    return F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd HH:mm:ss")


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def calendar_parts(time: Column) -> dict[str, Column]:
    return {
        "month": F.month(time),
        "day": F.dayofmonth(time),
        "weekday": F.weekday(time),
        "hour": F.hour(time),
    }


def day_cycle(day: Column) -> Column:
    return F.when(day + 15 < 31, day + 15).otherwise(day - 15)


def weekday_cycle(weekday: Column) -> Column:
    return F.when(weekday + 3 < 7, weekday + 3).otherwise(weekday - 3)


def hour_cycle(hour: Column) -> Column:
    """Half-day shift; the bound is 23, so hour 11 becomes -1."""
    return F.when(hour + 12 < 23, hour + 12).otherwise(hour - 12)


def day_period(hour: Column) -> Column:
    """Five parts of the day: 0 for 18-0 h, then 15-17, 12-14, 8-11, and 4 for 1-7 h."""
    return (
        F.when((hour == 0) | (hour > 17), 0)
        .when(hour > 14, 1)
        .when(hour > 11, 2)
        .when(hour > 7, 3)
        .otherwise(4)
    )


def is_sixth_or_seventh_of_month(time: Column) -> Column:
    return F.dayofmonth(time).isin(6, 7)


def is_sunday_code(weekday: Column) -> Column:
    """True for weekday numbers 6 and 7; with Monday as 0 that is Sunday only."""
    return weekday.isin(6, 7)


def is_weekend(time: Column) -> Column:
    return F.weekday(time) >= 5


def month_part(day: Column) -> Column:
    return F.when(day < 7, 0).when(day < 15, 1).when(day < 22, 2).otherwise(3)


def distance_to_whole_second(millis: Column) -> Column:
    rest = F.pmod(millis, F.lit(1000))
    return F.when(rest > 500, 1000 - rest).otherwise(rest)


def offset_log(x: Column, offset: float = 1.0) -> Column:
    return F.ln(x + offset)


def composite_key(*parts: Column) -> Column:
    """One string per combination; unlike ``concat_ws`` a null takes part, as ``nan``."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def epsilon_ratio(a: Column, b: Column, c: Column, epsilon: float = 1e-7) -> Column:
    return (a + epsilon) / (b + c + epsilon)


def rate(part: Column, whole: Column, empty: Column | float = 0.0) -> Column:
    """``part / whole`` with ``empty`` where the whole is zero."""
    other = empty if isinstance(empty, Column) else F.lit(float(empty))
    return F.when(whole == 0, other).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def rate_sql(part: str, whole: str, empty: str = "0.0D") -> str:
    """``rate`` as an expression on column names, for lists of many."""
    return f"case when `{whole}` = 0 then {empty} else try_divide(cast(`{part}` as double), cast(`{whole}` as double)) end"


def above(score: Column, threshold: float) -> Column:
    return (score > threshold).cast("int")


def blend(scores: list[Column], weights: list[float]) -> Column:
    terms = [s * w for s, w in zip(scores, weights, strict=True)]
    return sum(terms[1:], terms[0])


def named_like(columns: list[str], *patterns: str) -> list[str]:
    """Column names containing any of the patterns, in their given order."""
    return [c for c in columns if any(p in c for p in patterns)]


def null_if_missing(x: Column, marker: int = MISSING) -> Column:
    return F.nullif(x, F.lit(marker).cast("double"))


def clamp_negative(x: Column) -> Column:
    return F.when(x < 0, F.lit(NEGATIVE_DURATION)).otherwise(x)


def hashed_unit(key: Column, salt: str = "") -> Column:
    """A repeatable draw from [0, 1) per key, independent of the partitioning."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def hashed_uniform(key: Column, low: float, high: float, salt: str = "") -> Column:
    return low + (high - low) * hashed_unit(key, salt)
