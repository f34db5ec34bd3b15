"""Trailing windows and the feature families built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import DAYS, HABIT_DAYS, LOGS, VALUE_DAYS, logins, rounded, trades, within
from priorsight.functions.scalars import MISSING
from priorsight.operators import categories, families
from priorsight.operators.history import link_last_events, trailing_counts
from priorsight.plans.windows import window_totals

_LOGIN_PAIRS = """j as (select t.rowkey, l.*, t.us - l.us as gap from t left join l on l.id = t.id and l.us < t.us)"""
_TRADE_PAIRS = """p as (select t.rowkey, o.rowkey as other, o.period, t.us - o.us as gap
    from t left join t o on o.id = t.id and o.us < t.us)"""


def _columns(*parts: str) -> str:
    return ", ".join(parts)


@query(
    "W1_user_windows",
    f"with {LOGS}, {_LOGIN_PAIRS} select rowkey, "
    + _columns(
        *[
            f"count(*) filter (where {within(d)}) as logins_{d}, "
            f"count(*) filter (where {within(d)} and result < 0) as failures_{d}"
            for d in DAYS
        ]
    )
    + " from j group by rowkey",
)
def user_windows(spark, sf):
    measures = {"logins": F.lit(1).cast("long"), "failures": (F.col("result") < 0).cast("long")}
    counted = trailing_counts(logins(spark, sf), trades(spark, sf).select("rowkey", "id", "us"), DAYS, measures=measures)
    return counted.drop("id", "us")


@query(
    "W2_flattened_window_features",
    f"with {LOGS}, {_LOGIN_PAIRS}, {_TRADE_PAIRS}, "
    "a as (select rowkey, " + _columns(*[f"count(*) filter (where {within(d)}) as login_times_{d}" for d in HABIT_DAYS])
    + " from j group by rowkey), "
    "b as (select rowkey, " + _columns(*[f"count(*) filter (where {within(d)}) as trade_times_{d}" for d in HABIT_DAYS])
    + " from p group by rowkey) select t.rowkey, t.id, "
    + _columns(*[f"login_times_{d}, trade_times_{d}" for d in HABIT_DAYS])
    + " from t join a using (rowkey) join b using (rowkey)",
)
def flattened_window_features(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    events = families._both_logs(logins(spark, sf), trades(spark, sf), "id", [])
    one = {"login_times": F.col("is_login").cast("long"), "trade_times": (~F.col("is_login")).cast("long")}
    return window_totals(events, asked, ["id"], one, HABIT_DAYS).drop("us")


def _value_windows_sql(category: str) -> str:
    return (
        f"with {LOGS}, q as (select t.rowkey, t.us, (select l.{category} from l where l.id = t.id and l.us < t.us "
        f"order by l.us desc, l.log_id desc limit 1) as target from t) select q.rowkey, "
        + _columns(*[f"count(l.us) filter (where {within(d, 'q.us - l.us')}) as logins_{d}" for d in VALUE_DAYS])
        + f" from q left join l on l.{category} = q.target and l.us < q.us group by q.rowkey"
    )


def _value_windows(spark, sf, category):
    log = logins(spark, sf)
    linked = link_last_events(log, trades(spark, sf).select("rowkey", "id", "us"), [category], 1)
    asked = linked.select("rowkey", "us", F.col(f"last_0.{category}").alias(category))
    seen = log.filter(F.col(category).isNotNull())
    return trailing_counts(seen, asked, VALUE_DAYS, (category,), {"logins": F.lit(1).cast("long")}).drop("us", category)


@query("W3_category_windows", _value_windows_sql("device"))
def category_windows(spark, sf):
    return _value_windows(spark, sf, "device")


@query(
    "W4_several_categories",
    f"with ip as ({_value_windows_sql('ip')}), device as ({_value_windows_sql('device')}) select rowkey, "
    + _columns(*[f"{c}.logins_{d} as {c}_logins_{d}" for c in ("ip", "device") for d in VALUE_DAYS])
    + " from ip join device using (rowkey)",
)
def several_categories(spark, sf):
    parts = [
        _value_windows(spark, sf, c).withColumnsRenamed({f"logins_{d}": f"{c}_logins_{d}" for d in VALUE_DAYS})
        for c in ("ip", "device")
    ]
    return parts[0].join(parts[1], "rowkey")


def _statistics_sql(crowded: str = "100.0", empty: str = "0.0") -> str:
    def rate(a, b, none):
        return f"round(case when {b} = 0 then {none} else {a} / {b} end, 6)"

    features = []
    for d in DAYS:
        none = f"case when tn_{d} > 0 then {crowded} else {empty} end"
        features += [
            f"tn_{d} as trade_times_{d}, n_{d} as login_times_{d}, good_{d} as login_success_times_{d}, bad_{d} as login_fail_times_{d}",
            rate(f"tn_{d}", f"n_{d}", none) + f" as trade_login_rate_{d}",
            rate(f"good_{d}", f"n_{d}", empty) + f" as login_success_rate_{d}",
            rate(f"tn_{d}", f"good_{d}", none) + f" as trade_login_success_rate_{d}",
            rate(f"tn_{d}", f"bad_{d}", none) + f" as trade_login_fail_rate_{d}",
        ]
    return (
        f"with {LOGS}, {_LOGIN_PAIRS}, {_TRADE_PAIRS}, a as (select rowkey, "
        + _columns(
            *[
                f"count(*) filter (where {within(d)}) as n_{d}, count(*) filter (where {within(d)} and result > 0) as good_{d}, "
                f"count(*) filter (where {within(d)} and result < 0) as bad_{d}"
                for d in DAYS
            ]
        )
        + " from j group by rowkey), b as (select rowkey, "
        + _columns(*[f"count(*) filter (where {within(d)}) as tn_{d}" for d in DAYS])
        + f" from p group by rowkey) select rowkey, {_columns(*features)} from a join b using (rowkey)"
    )


@query("E1_login_trade_statistics", _statistics_sql())
def login_trade_statistics(spark, sf):
    return rounded(families.login_trade_statistics(logins(spark, sf), trades(spark, sf), DAYS))


@query("E5_older_statistics", _statistics_sql("100.0", "-10.0"))
def older_statistics(spark, sf):
    return rounded(families.login_trade_statistics(logins(spark, sf), trades(spark, sf), DAYS, empty=MISSING))


def _spread_sql(value: str, d: int, name: str, more: str = "") -> str:
    on = f"filter (where {within(d)}{more})"
    return (
        f"round(avg({value}) {on}, 6) as {name}_mean_{d}, round(max({value}) {on}, 6) as {name}_max_{d}, "
        f"round(min({value}) {on}, 6) as {name}_min_{d}, round(median({value}) {on}, 6) as {name}_med_{d}, "
        f"round(case when count({value}) {on} > 1 then stddev_pop({value}) {on} end, 6) as {name}_std_{d}"
    )


@query(
    "E2_duration_statistics",
    f"with {LOGS}, {_LOGIN_PAIRS} select rowkey, "
    + _columns(*[_spread_sql("ln(timelong + 1)", d, "timelong") for d in DAYS])
    + " from j group by rowkey",
)
def duration_statistics(spark, sf):
    return rounded(families.duration_statistics(logins(spark, sf), trades(spark, sf), DAYS))


@query(
    "E5_plain_log_durations",
    f"with {LOGS}, {_LOGIN_PAIRS} select rowkey, "
    + _columns(*[_spread_sql("ln(nullif(greatest(timelong, 0), 0))", d, "timelong") for d in DAYS])
    + " from j group by rowkey",
)
def plain_log_durations(spark, sf):
    return rounded(families.duration_statistics(logins(spark, sf), trades(spark, sf), DAYS, offset=0.0))


_FOLLOWED = (
    "f as (select *, lead(us) over (partition by id order by us, log_id) as next_us, "
    "lead(result) over (partition by id order by us, log_id) as next_result from l), "
    "j as (select t.rowkey, t.us as trade_us, f.*, t.us - f.us as gap from t left join f on f.id = t.id and f.us < t.us)"
)


@query(
    "E3_repeated_failures",
    f"with {LOGS}, {_FOLLOWED} select rowkey, "
    + _columns(
        *[
            f"cast(count(*) filter (where {within(d)} and result < 0 and next_result < 0 and next_us < trade_us) > 0 "
            f"and count(*) filter (where {within(d)}) > 2 as int) as multiple_fails_{d}"
            for d in DAYS
        ]
    )
    + " from j group by rowkey",
)
def repeated_failures(spark, sf):
    return families.repeated_failure_flags(logins(spark, sf), trades(spark, sf), DAYS)


@query(
    "E4_recovery_statistics",
    f"with {LOGS}, {_FOLLOWED}, s as (select rowkey, "
    + _columns(
        *[
            f"sum(result) filter (where {within(d)}) as codes_{d}, count(*) filter (where {within(d)}) as n_{d}, "
            + _spread_sql("ln((next_us - us) / 1e6 + 1)", d, "x", " and result < 0 and next_us < trade_us")
            for d in DAYS
        ]
    )
    + " from j group by rowkey) select rowkey, "
    + _columns(
        *[
            f"case when codes_{d} >= 1 and n_{d} >= 2 then x_{s}_{d} end as after_fail_{s}_{d}"
            for d in DAYS
            for s in ("mean", "max", "min", "med", "std")
        ]
    )
    + " from s",
)
def recovery_statistics(spark, sf):
    return rounded(families.recovery_statistics(logins(spark, sf), trades(spark, sf), DAYS))


def _habit_sql() -> str:
    counts = {"is_scan_count": ("j", "is_scan = 1", "n")}
    counts |= {f"type_{v}_count": ("j", f"type = {v}", "n") for v in (1, 2, 3)}
    counts |= {f"log_from_{v}_count": ("j", f"log_from = {v}", "n") for v in (1, 2, 10, 11, 21)}
    counts |= {f"success_{v}_count": ("j", f"result = {v}", "good") for v in (1, 31)}
    counts |= {f"fail_{v}_count": ("j", f"result = {v}", "bad") for v in (-1, -2)}
    for p in range(5):
        counts[f"period_{p}_login_times"] = ("j", f"period = {p}", "n")
        counts[f"period_{p}_trade_times"] = ("p", f"period = {p}", "tn")
    inner = {"j": [], "p": []}
    outer = []
    for d in HABIT_DAYS:
        inner["j"] += [
            f"count(*) filter (where {within(d)}) as n_{d}, count(*) filter (where {within(d)} and result > 0) as good_{d}",
            f"count(*) filter (where {within(d)} and not result > 0) as bad_{d}",
        ]
        inner["p"].append(f"count(*) filter (where {within(d)}) as tn_{d}")
        for name, (source, condition, base) in counts.items():
            inner[source].append(f'count(*) filter (where {within(d)} and {condition}) as "{name}_{d}"')
            stem = name.removesuffix("_count").removesuffix("_times")
            outer.append(f'"{name}_{d}", round(case when {base}_{d} = 0 then 0 else "{name}_{d}" / {base}_{d} end, 6) as "{stem}_rate_{d}"')
    return (
        f"with {LOGS}, {_LOGIN_PAIRS}, {_TRADE_PAIRS}, a as (select rowkey, {_columns(*inner['j'])} from j group by rowkey), "
        f"b as (select rowkey, {_columns(*inner['p'])} from p group by rowkey) "
        f"select rowkey, {_columns(*outer)} from a join b using (rowkey)"
    )


@query("E6_habits", _habit_sql())
def habits(spark, sf):
    return rounded(families.habit_features(logins(spark, sf), trades(spark, sf), HABIT_DAYS))


_LINKED = (
    "links as (select t.rowkey, (select l.log_id from l where l.id = t.id and l.us < t.us "
    "order by l.us desc, l.log_id desc limit 1) as recent_login_id_0 from t), "
    "lt as (select * from l where log_id in (select recent_login_id_0 from links))"
)


def _repeat_sql(category: str, log: str, suffix: str = "") -> str:
    c = category + suffix
    per_day = {
        "repeat_count": "n", "repeat_rate": "round(n / total, 6)", "used_count": "used", "freq_rank": "place",
        "most_freq_count": "top", "most_freq_rate": "round(top / total, 6)", "max_min_dist": "round((top - low) / top, 6)",
    }
    ds = ", ".join(f"({d})" for d in VALUE_DAYS)
    return (
        f"g as (select t.rowkey, d, x.{category} as v, count(*) as n, max(row(x.us, x.log_id)) as newest "
        f"from t join {log} x on x.id = t.id and x.us < t.us, (values {ds}) w(d) "
        f"where t.us - x.us < d * 86400000000::bigint group by all), "
        "r as (select *, rank() over (partition by rowkey, d order by n) as place, "
        "cast(sum(n) over (partition by rowkey, d) as bigint) as total, count(*) over (partition by rowkey, d) as used, "
        "max(n) over (partition by rowkey, d) as top, min(n) over (partition by rowkey, d) as low, "
        "max(newest) over (partition by rowkey, d) as last from g), "
        "s as (select * from r where newest = last) select t.rowkey, "
        + _columns(*[f"max({e}) filter (where d = {d}) as {c}_{f}_{d}" for d in VALUE_DAYS for f, e in per_day.items()])
        + " from t left join s on s.rowkey = t.rowkey group by t.rowkey"
    )


def _profile_sql(category: str, log: str, suffix: str = "") -> str:
    c = category + suffix
    per_day = {
        "login_count": "coalesce(sum(n) filter (where d = {d}), 0)::bigint",
        "same_id_login_count": "coalesce(sum(n) filter (where d = {d} and user_id = owner), 0)::bigint",
        "diff_id_counts": "count(user_id) filter (where d = {d})",
        "most_used_id_counts": "coalesce(max(n) filter (where d = {d}), 0)",
        "same_id_login_rate": "round(coalesce(sum(n) filter (where d = {d} and user_id = owner) / sum(n) filter (where d = {d}), 0), 6)",
        "most_used_id_rate": "round(coalesce(max(n) filter (where d = {d}) / sum(n) filter (where d = {d}), 0), 6)",
    }
    ds = ", ".join(f"({d})" for d in VALUE_DAYS)
    return (
        f"q as (select t.rowkey, t.id, t.us, (select l.{category} from l where l.id = t.id and l.us < t.us "
        f"order by l.us desc, l.log_id desc limit 1) as target from t), "
        f"g as (select q.rowkey, d, x.id as user_id, count(*) as n from q join {log} x on x.{category} = q.target and x.us < q.us, "
        f"(values {ds}) w(d) where q.us - x.us < d * 86400000000::bigint group by all), "
        f"h as (select q.rowkey, q.id as owner, g.d, g.user_id, g.n from q left join g on g.rowkey = q.rowkey) select rowkey, "
        + _columns(*[f"{e.format(d=d)} as {c}_{f}_{d}" for d in VALUE_DAYS for f, e in per_day.items()])
        + " from h group by rowkey"
    )


def _links(spark, sf):
    linked = link_last_events(logins(spark, sf), trades(spark, sf).select("rowkey", "id", "us"), ["log_id"], 1)
    return linked.select("rowkey", F.col("last_0.log_id").alias("recent_login_id_0"))


def _register_category(category: str) -> None:
    @query(f"E7_repeat_{category}", f"with {LOGS}, " + _repeat_sql(category, "l"))
    def repeat(spark, sf):
        return rounded(categories.repeat_statistics(logins(spark, sf), trades(spark, sf), category, VALUE_DAYS))

    @query(f"E8_repeat_{category}_linked", f"with {LOGS}, {_LINKED}, " + _repeat_sql(category, "lt", "_t"))
    def repeat_linked(spark, sf):
        return rounded(
            categories.linked_repeat_statistics(
                logins(spark, sf), _links(spark, sf), trades(spark, sf), category, VALUE_DAYS
            )
        )


def _register_profile(category: str) -> None:
    @query(f"E9_profile_{category}", f"with {LOGS}, " + _profile_sql(category, "l"))
    def profile(spark, sf):
        return rounded(categories.shared_value_profile(logins(spark, sf), trades(spark, sf), category, VALUE_DAYS))

    @query(f"E10_profile_{category}_linked", f"with {LOGS}, {_LINKED}, " + _profile_sql(category, "lt", "_t"))
    def profile_linked(spark, sf):
        return rounded(
            categories.linked_value_profile(
                logins(spark, sf), _links(spark, sf), trades(spark, sf), category, VALUE_DAYS
            )
        )


for _category in ("ip", "device", "city"):
    _register_category(_category)
for _category in ("ip", "device"):
    _register_profile(_category)
