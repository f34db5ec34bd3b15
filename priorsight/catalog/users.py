"""User aggregates and the trade table built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, logins, rounded, trades
from priorsight.operators import users
from priorsight.operators.history import link_last_events, with_last_event


@query("F1_distinct_users", f"with {LOGS} select distinct id from l")
def distinct_users(spark, sf):
    return users.distinct_users(logins(spark, sf))


@query(
    "F2_whole_second_counts",
    f"with {LOGS} select id, count(*) filter (where timelong % 1000 = 0) as whole_second, "
    "count(*) filter (where timelong % 1000 <> 0) as broken_second from l group by id",
)
def whole_second_counts(spark, sf):
    return logins(spark, sf).groupBy("id").agg(*users.whole_second_counts(F.col("timelong")))


_COUNTED = ("device", "ip", "log_from", "type", "city", "log_id")


@query("F3_distinct_counts", f"with {LOGS} select id, " + ", ".join(f'count(distinct {c}) as "{c}_Counts"' for c in _COUNTED) + " from l group by id")
def distinct_counts(spark, sf):
    return logins(spark, sf).groupBy("id").agg(*users.distinct_counts(_COUNTED))


@query(
    "F3_approximate_distinct_counts",
    f"with {LOGS} select id, " + ", ".join(f'count(distinct {c}) as "{c}_Counts"' for c in _COUNTED) + " from l where day(time) between 8 and 21 group by id",
)
def approximate_distinct_counts(spark, sf):
    """Two weeks rolled up from daily sketches; a sketch of a few hundred values counts them exactly."""
    sketches = users.daily_sketches(logins(spark, sf), _COUNTED)
    return users.rolled_up(sketches.filter(F.dayofmonth("day").between(8, 21)), _COUNTED)


def _spread(name: str, which: str, sql: str) -> None:
    @query(name, f'with {LOGS} select id, round({sql}(timelong), 3) as "timelong_{which}" from l group by id')
    def one(spark, sf):
        return rounded(logins(spark, sf).groupBy("id").agg(*users.spread("timelong", (which,))), 3)


for _name, _which, _sql in (
    ("F4_mean", "Mean", "avg"), ("F5_min", "min", "min"), ("F6_max", "max", "max"),
    ("F7_variance", "var", "var_samp"), ("F8_deviation", "std", "stddev_samp"),
):
    _spread(_name, _which, _sql)


@query("F9_other_results", f'with {LOGS} select id, count(*) as "result_no1_Counts" from l where result <> 1 group by id')
def other_results(spark, sf):
    counted = logins(spark, sf).groupBy("id").agg(users.other_results())
    return counted.filter(F.col("result_no1_Counts") > 0)


_SHARE = """{c}_s as (select log_id, count(*) over (partition by id, {c}) / count({c}) over (partition by id) as {c}_scale from l where {c} is not null)"""


@query(
    "F10_value_share",
    f"with {LOGS}, {_SHARE.format(c='device')}, {_SHARE.format(c='city')} select log_id, round(device_scale, 6) as device_scale, "
    "round(city_scale, 6) as city_scale from device_s join city_s using (log_id)",
)
def value_share(spark, sf):
    log = logins(spark, sf)
    return rounded(users.value_share(log, "device").join(users.value_share(log, "city"), "log_id"))


def _linked_trades(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us", "time", "is_risk")
    return with_last_event(logins(spark, sf), asked, {"log_id": "login_id"})


_TRADE_FEATURES = f"""{_SHARE.format(c='device')}, {_SHARE.format(c='city')},
li as (select t.*, (select l.log_id from l where l.id = t.id and l.us < t.us order by l.us desc, l.log_id desc limit 1) as login_id from t),
tf as (select li.rowkey, li.id, li.is_risk, hour(li.time) as hours,
    (epoch_us(li.time) // 1000000 - epoch_us(l.time) // 1000000) % 86400 as st,
    round(device_scale, 6) as device_scale, round(city_scale, 6) as city_scale from li join l on l.log_id = li.login_id
    join device_s on device_s.log_id = login_id join city_s on city_s.log_id = login_id)"""


@query("F11_trade_login_features", f"with {LOGS}, {_TRADE_FEATURES} select * from tf")
def trade_login_features(spark, sf):
    features = users.trade_login_features(_linked_trades(spark, sf), logins(spark, sf))
    return rounded(features.select("rowkey", "id", "is_risk", "hours", "st", "device_scale", "city_scale"))


_PREVIOUS = "select rowkey, (us - lag(us) over (partition by id order by us, rowkey)) // 86400000000 as trade_gap_days from t"


@query("F11_previous_trade_gap", f"with {LOGS} {_PREVIOUS}")
def previous_trade_gap(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    linked = link_last_events(asked, asked, [], 1, order="rowkey")
    return linked.select("rowkey", F.expr("(us - last_0.us) div 86400000000").alias("trade_gap_days"))


@query(
    "F12_user_trade_table",
    f"with {LOGS}, {_TRADE_FEATURES}, u as (select id, count(*) filter (where timelong % 1000 = 0) as whole_second, "
    "count(*) filter (where timelong % 1000 <> 0) as broken_second, min(timelong) as timelong_min, max(timelong) as timelong_max, "
    'round(avg(timelong), 3) as "timelong_Mean", round(stddev_samp(timelong), 3) as timelong_std, '
    + ", ".join(f'count(distinct {c}) as "{c}_Counts"' for c in _COUNTED)
    + ', count(*) filter (where result <> 1) as "result_no1_Counts" from l group by id having count(*) filter (where result <> 1) > 0) '
    "select * from u join tf using (id)",
)
def user_trade_table(spark, sf):
    log = logins(spark, sf)
    per_user = rounded(users.user_table(log), 3)
    features = users.trade_login_features(_linked_trades(spark, sf), log)
    features = rounded(features.select("rowkey", "id", "is_risk", "hours", "st", "device_scale", "city_scale"))
    return users.users_with_trades(per_user, features)


@query(
    "F13_scores_for_all",
    f"with {LOGS}, u as (select id from l where result <> 1 group by id having count(*) > 40), "
    "s as (select rowkey, cast(amount > 80 as int) as is_risk from t where id in (select id from u)) "
    "select t.rowkey, coalesce(s.is_risk, 0) as is_risk from t left join s on s.rowkey = t.rowkey",
)
def scores_for_all(spark, sf):
    some = logins(spark, sf).filter("result <> 1").groupBy("id").count().filter("count > 40")
    log = trades(spark, sf)
    scored = log.join(some, "id", "left_semi").select("rowkey", (F.col("amount") > 80).cast("int").alias("is_risk"))
    return users.scores_for_all(log, scored)
