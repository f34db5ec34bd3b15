"""Feature families over trailing windows of a user's logins and trades."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorsight.functions.scalars import rate_sql
from priorsight.plans.lineage import cut
from priorsight.plans.timegrid import DAY_US, measure_widths, running_totals, with_lane
from priorsight.plans.windows import window_order_statistics, window_totals

# Keys with more events than this look up the codes of their windows by distributed
# digit search; the frames of smaller keys fit a task many times over.  Both find the same codes.
FRAME_ROWS = 2_000

# Bits of the whole number that the largest value becomes: sums of its squares stay
# below 38 digits for 10^11 rows, and 2^-45 of the largest value is below any digit compared.
VALUE_BITS = 44


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def _both_logs(logins: DataFrame, trades: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    login_rows = logins.select(key, "us", F.lit(True).alias("is_login"), F.xxhash64("log_id").alias("event"), *columns)
    trade_rows = trades.select(
        key, "us", F.lit(False).alias("is_login"), F.xxhash64("rowkey").alias("event"), *[c for c in columns if c in trades.columns]
    )
    return login_rows.unionByName(trade_rows, allowMissingColumns=True)


def login_trade_statistics(
    logins: DataFrame, trades: DataFrame, days: Sequence[int], key: str = "id", empty: float = 0.0, crowded: float = 100.0
) -> DataFrame:
    """Counts of trades and logins per window, and the rates between them.

    A rate over no logins is ``crowded`` if there were trades and ``empty``
    otherwise.  ``trade_login_fail_rate`` follows the same rule.
    """
    login = F.col("is_login")
    measures = {
        "trade_times": _flag(~login),
        "login_times": _flag(login),
        "login_success_times": _flag(login & (F.col("result") > 0)),
        "login_fail_times": _flag(login & (F.col("result") < 0)),
    }
    events = _both_logs(logins, trades, key, ["result"])
    counted = window_totals(events, trades.select("rowkey", key, "us"), [key], measures, days)
    features = []
    for d in days:
        n_trades, n_logins, good, bad = (f"{m}_{d}" for m in measures)
        none = f"case when `{n_trades}` > 0 then {float(crowded)}D else {float(empty)}D end"
        features += [
            n_trades, n_logins, good, bad,
            f"{rate_sql(n_trades, n_logins, none)} as trade_login_rate_{d}",
            f"{rate_sql(good, n_logins, f'{float(empty)}D')} as login_success_rate_{d}",
            f"{rate_sql(n_trades, good, none)} as trade_login_success_rate_{d}",
            f"{rate_sql(n_trades, bad, none)} as trade_login_fail_rate_{d}",
        ]
    return counted.selectExpr("rowkey", *features)


def repeated_failure_flags(
    logins: DataFrame, trades: DataFrame, days: Sequence[int], key: str = "id", order: str = "log_id"
) -> DataFrame:
    """``multiple_fails_<d>``: two logins in a row failed within the window and it holds more than two."""
    queries = trades.select("rowkey", key, "us")
    widths = measure_widths([logins, queries], [key])
    paired = _with_following(logins, key, order, widths).filter(
        (F.col("result") < 0) & (F.col("next_result") < 0)
    )
    pairs = window_totals(
        paired, queries, [key], {"pairs": F.lit(1).cast("long")}, days, widths, start="next_us", since="us"
    )
    both = window_totals(logins, pairs, [key], {"logins": F.lit(1).cast("long")}, days, widths)
    return both.select(
        "rowkey",
        *[((F.col(f"pairs_{d}") > 0) & (F.col(f"logins_{d}") > 2)).cast("int").alias(f"multiple_fails_{d}") for d in days],
    )


def _with_following(logins: DataFrame, key: str, order: str, widths: Sequence[int]) -> DataFrame:
    """Logins with time and result of the user's next one; a user's last login is left out."""
    record = F.struct(F.col("us").alias("us"), F.col(order).alias("at"), F.col("result").alias("result")).alias("record")
    rows = with_lane(logins.dropna(subset=[key]).select(key, "us", order, "result", record), widths, key, order)
    followed = running_totals(rows, [key], [], widths, "us", (order,), ahead="record")
    return followed.filter(F.col("next_record").isNotNull()).select(
        key, "us", order, "result",
        F.col("next_record.us").alias("next_us"), F.col("next_record.result").alias("next_result"),
    )


def value_statistics(
    events: DataFrame,
    queries: DataFrame,
    days: Sequence[int],
    value: Callable[[Column], Column],
    key: str = "id",
    code: str = "code",
    start: str = "us",
    since: str = "us",
    widths: Sequence[int] | None = None,
    frame_rows: int = FRAME_ROWS,
) -> DataFrame:
    """Count, mean, max, min, median and population deviation of ``value(code)`` per window.

    ``code`` is a non-negative long and ``value`` rises with it.  Returns
    ``rowkey`` and ``{n,mean,max,min,med,std}_<d>``; all but ``n`` are null for
    an empty window, and ``std`` also for a single value.

    Counts, means and deviations come from exact sums of whole numbers, whatever the size of a key: values
    are scaled so that the largest has VALUE_BITS bits.  The codes at a position are looked up in frames or by
    digit search; both find the same code.
    """
    events = events.dropna(subset=[key])
    if widths is None:
        widths = measure_widths([events.withColumn("us", F.col(since)), queries], [key])
    asked = queries.select("rowkey", key, "us")
    ends = events.agg(F.max(F.abs(value(F.col(code)))).alias("m")).first()["m"]
    scale = 2.0 ** (VALUE_BITS - math.frexp(float(ends or 1.0))[1])
    whole = F.round(value(F.col(code)) * F.lit(scale)).cast("decimal(38,0)")
    measures = {"n": F.lit(1).cast("long"), "sum1": whole, "sum2": (whole * whole).cast("decimal(38,0)")}
    totals = cut(window_totals(events, asked, [key], measures, days, widths, start, since))
    codes = _window_codes(events, totals, days, key, code, start, since, widths, frame_rows)
    joined = totals.drop(key, "us").join(codes, "rowkey", "left")
    out = []
    for d in days:
        n, sum1, sum2 = F.col(f"n_{d}"), F.col(f"sum1_{d}"), F.col(f"sum2_{d}")
        some = n > 0
        # Around the whole part of the mean, so that squares of near values do not cancel; equal values leave nothing.
        middle = F.when(some, F.expr(f"cast(sum1_{d} div n_{d} as decimal(20,0))"))
        rest = (sum1 - middle * n).cast("decimal(38,0)")
        apart = (sum2 - (middle * 2 * sum1).cast("decimal(38,0)") + (middle * middle * n).cast("decimal(38,0)")).cast("double")
        part = rest.cast("double") / n
        spread = F.greatest(apart / n - part * part, F.lit(0.0))
        at = {p: value(F.col(f"{p}_code_{d}")) for p in ("max", "min", "lower", "upper")}
        out += [
            n,
            F.when(some, (middle.cast("double") + part) / scale).alias(f"mean_{d}"),
            F.when(some, at["max"]).alias(f"max_{d}"),
            F.when(some, at["min"]).alias(f"min_{d}"),
            F.when(some, (at["lower"] + at["upper"]) / 2).alias(f"med_{d}"),
            F.when(n > 1, F.sqrt(spread) / scale).alias(f"std_{d}"),
        ]
    return joined.select("rowkey", *out)


_PLACES = ("max", "min", "lower", "upper")


def _window_codes(events, totals, days, key, code, start, since, widths, frame_rows) -> DataFrame:
    """``rowkey`` and ``{max,min,lower,upper}_code_<d>`` of the queries whose windows hold anything."""
    found = totals.filter(" or ".join(f"n_{d} > 0" for d in days))
    sizes = events.select(key).unionAll(found.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    large = cut(sizes.filter(F.col("rows") > frame_rows).select(key))
    if large.isEmpty():
        return _framed_codes(events, found, days, key, code, start, since)
    small_part = _framed_codes(events.join(large, key, "left_anti"), found.join(large, key, "left_anti"), days, key, code, start, since)
    large_part = _searched_codes(events.join(large, key, "left_semi"), found.join(large, key, "left_semi"), days, key, code, start, since, widths)
    return small_part.unionByName(large_part)


def _framed_codes(events, found, days, key, code, start, since) -> DataFrame:
    item = F.struct(F.col(start).alias("start"), F.col(code).cast("long").alias("code"))
    rows = events.select(key, F.col(since).alias("us"), item.alias("item"), F.lit(True).alias("is_event")).unionByName(
        found.select("rowkey", key, "us", F.lit(False).alias("is_event")), allowMissingColumns=True
    )
    frames = {d: Window.partitionBy(key).orderBy("us").rangeBetween(-(d * DAY_US - 1), -1) for d in days}
    seen = rows.select("rowkey", "us", "is_event", *[F.collect_list("item").over(w).alias(f"seen_{d}") for d, w in frames.items()]).filter(~F.col("is_event"))
    inside = {d: F.filter(f"seen_{d}", lambda x: x["start"] < F.col("us")) for d in days}
    codes = seen.select("rowkey", *[F.array_sort(F.transform(inside[d], lambda x: x["code"])).alias(f"codes_{d}") for d in days])
    out = ["rowkey"]
    for d in days:
        c = F.col(f"codes_{d}")
        n = F.size(c)
        place = {"max": n - 1, "min": F.lit(0), "lower": F.floor((n - 1) / 2).cast("int"), "upper": F.floor(n / 2).cast("int")}
        out += [F.when(n > 0, F.get(c, place[p])).alias(f"{p}_code_{d}") for p in _PLACES]
    return codes.select(*out)


def _searched_codes(events, found, days, key, code, start, since, widths) -> DataFrame:
    places = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("d"), F.lit(p).alias("place"), pos.cast("long").alias("pos"))
                for d in days
                for n in [F.col(f"n_{d}")]
                for p, pos in (("max", n - 1), ("min", F.when(n > 0, 0).otherwise(-1)), ("lower", F.floor((n - 1) / 2)), ("upper", F.when(n > 0, F.floor(n / 2)).otherwise(-1)))
            ]
        )
    )
    # Empty windows ask for no position.
    wanted = found.select("rowkey", key, "us", places.alias("w")).select("rowkey", key, "us", "w.*").filter(F.col("pos") >= 0)
    picked = window_order_statistics(events, wanted, [key], code, days, widths, start, since)
    return picked.groupBy("rowkey").agg(
        *[F.max(F.when((F.col("d") == d) & (F.col("place") == p), F.col("code"))).alias(f"{p}_code_{d}") for d in days for p in _PLACES]
    )


def duration_statistics(
    logins: DataFrame, trades: DataFrame, days: Sequence[int], key: str = "id", duration: str = "timelong",
    offset: float = 1.0, frame_rows: int = FRAME_ROWS,
) -> DataFrame:
    """``timelong_{mean,max,min,med,std}_<d>`` of the logarithm of the login duration."""
    events = logins.filter(F.col(duration) + offset > 0).select(
        key, "us", F.col(duration).cast("long").alias("code"), F.xxhash64("log_id").alias("event")
    )
    stats = value_statistics(
        events, trades.select("rowkey", key, "us"), days, lambda c: F.ln(c + offset), key, frame_rows=frame_rows
    )
    return stats.select(
        "rowkey", *[F.col(f"{s}_{d}").alias(f"timelong_{s}_{d}") for d in days for s in ("mean", "max", "min", "med", "std")]
    )


def recovery_statistics(
    logins: DataFrame, trades: DataFrame, days: Sequence[int], key: str = "id", order: str = "log_id",
    frame_rows: int = FRAME_ROWS,
) -> DataFrame:
    """``after_fail_{mean,max,min,med,std}_<d>``: log seconds from a failed login to the next attempt.

    Only where the result codes of the window add up to at least one and it
    holds two logins or more; both logins must lie in the window.
    """
    queries = trades.select("rowkey", key, "us")
    widths = measure_widths([logins, queries], [key])
    failed = _with_following(logins, key, order, widths).filter(F.col("result") < 0)
    events = failed.select(key, "us", "next_us", order, (F.col("next_us") - F.col("us")).alias("code"))
    stats = value_statistics(
        events, queries, days, lambda c: F.ln(c / 1e6 + 1), key, start="next_us", since="us",
        widths=widths, frame_rows=frame_rows,
    )
    gate = window_totals(
        logins, queries, [key],
        {"codes": F.coalesce(F.col("result").cast("long"), F.lit(0).cast("long")), "logins": F.lit(1).cast("long")},
        days, widths,
    ).drop(key, "us")
    joined = stats.join(gate, "rowkey")
    return joined.select(
        "rowkey",
        *[
            F.when((F.col(f"codes_{d}") >= 1) & (F.col(f"logins_{d}") >= 2), F.col(f"{s}_{d}")).alias(f"after_fail_{s}_{d}")
            for d in days
            for s in ("mean", "max", "min", "med", "std")
        ],
    )


# The codes that have habit features of their own.
LOGIN_TYPES = (1, 2, 3)
LOGIN_SOURCES = (1, 2, 10, 11, 21)
SUCCESS_CODES = (1, 31)
FAILURE_CODES = (-1, -2)
DAY_PERIODS = 5


def habit_features(
    logins: DataFrame, trades: DataFrame, days: Sequence[int], key: str = "id",
    types: Sequence = LOGIN_TYPES, sources: Sequence = LOGIN_SOURCES,
    successes: Sequence = SUCCESS_CODES, failures: Sequence = FAILURE_CODES,
) -> DataFrame:
    """Counts and rates of a user's habits per window.

    Logins need ``is_scan, type, log_from, result, period``; trades ``period``.
    Failures are all logins without success, result 0 included.
    """
    login = F.col("is_login")
    count = {
        "login_all": _flag(login),
        "trade_all": _flag(~login),
        "success_all": _flag(login & (F.col("result") > 0)),
        "is_scan_count": F.when(login, F.coalesce(F.col("is_scan").cast("long"), F.lit(0))).otherwise(0).cast("long"),
    }
    count |= {f"type_{v}_count": _flag(login & (F.col("type") == v)) for v in types}
    count |= {f"log_from_{v}_count": _flag(login & (F.col("log_from") == v)) for v in sources}
    count |= {f"success_{v}_count": _flag(login & (F.col("result") == v)) for v in successes}
    count |= {f"fail_{v}_count": _flag(login & (F.col("result") == v)) for v in failures}
    for p in range(DAY_PERIODS):
        count[f"period_{p}_login_times"] = _flag(login & (F.col("period") == p))
        count[f"period_{p}_trade_times"] = _flag(~login & (F.col("period") == p))
    events = _both_logs(logins, trades, key, ["is_scan", "type", "log_from", "result", "period"])
    counted = window_totals(events, trades.select("rowkey", key, "us"), [key], count, days)
    out = []
    for d in days:
        for name in list(count)[3:]:
            stem = name.removesuffix("_count").removesuffix("_times")
            base = {"success": "success_all", "fail": "fail_all"}.get(name.split("_")[0], "login_all")
            base = "trade_all" if stem.endswith("_trade") else base
            out += [f"`{name}_{d}`", f"{rate_sql(f'{name}_{d}', f'{base}_{d}')} as `{stem}_rate_{d}`"]
    failed = [f"login_all_{d} - success_all_{d} as fail_all_{d}" for d in days]
    return counted.selectExpr("*", *failed).selectExpr("rowkey", *out)
