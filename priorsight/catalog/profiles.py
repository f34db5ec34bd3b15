"""Profiles of the logs and of the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, logins, rounded, table, trades
from priorsight.functions import scalars as S
from priorsight.operators import profile
from priorsight.operators.links import recent_details
from priorsight.operators.history import link_last_events


@query("P1_label_ratio", f"with {LOGS} select is_risk, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from t group by 1")
def label_ratio(spark, sf):
    return rounded(profile.with_share(profile.value_counts(trades(spark, sf), "is_risk")))


@query(
    "P2_key_overlap",
    "with a as (select distinct o_custkey as c from orders where month(o_orderdate) <= 6), b as (select distinct o_custkey as c from orders where month(o_orderdate) > 6) "
    "select (select count(*) from a) as keys_a, (select count(*) from b) as keys_b, (select count(*) from (select c from a union select c from b)) as keys_any, "
    "(select count(*) from (select c from a except select c from b)) as only_a, (select count(*) from (select c from b except select c from a)) as only_b, "
    "(select count(*) from (select c from a intersect select c from b)) as in_both",
)
def key_overlap(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.month("o_orderdate").alias("m"))
    return profile.key_overlap(orders.filter("m <= 6"), orders.filter("m > 6"), "o_custkey")


@query(
    "P3_events_per_user",
    "with c as (select user_id, count(*) as n from events group by 1) select count(*) as n, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, "
    "min(n) as low, max(n) as high, quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as q50, quantile_cont(n, 0.75) as q75 from c",
)
def events_per_user(spark, sf):
    return rounded(profile.summary(profile.value_counts(table(spark, sf, "events"), "user_id"), "n"))


_TRIMMED = (
    "c as (select o_custkey, cast(count(*) as double) as x from orders group by 1), e as (select quantile_cont(x, 0.95) as edge from c), "
    "k as (select x from c, e where x < edge), r as (select min(x) as low, (max(x) - min(x)) / 10 as width from k), "
    "b as (select cast(least(floor((x - low) / width), 9) as int) as bin, count(*) as n, any_value(low) as low, any_value(width) as width from k, r group by 1), "
    "h as (select bin, n, low + bin * width as from_value, low + (bin + 1) * width as to_value from b)"
)


def _order_histogram(spark, sf):
    return profile.histogram(profile.value_counts(table(spark, sf, "orders"), "o_custkey"), "n", 10, 0.95)


@query("P4_trimmed_histogram", f"with {_TRIMMED} select bin, n, round(from_value, 6) as from_value, round(to_value, 6) as to_value from h")
def trimmed_histogram(spark, sf):
    return rounded(_order_histogram(spark, sf))


@query("P7_histogram_mean", f"with {_TRIMMED} select round(sum((from_value + to_value) / 2 * n) / sum(n), 6) as mean from h")
def histogram_mean(spark, sf):
    return rounded(profile.histogram_mean(_order_histogram(spark, sf)))


@query(
    "P5_pareto",
    "with c as (select o_custkey, count(*) as n from orders group by 1), w as (select *, row_number() over (order by n desc, o_custkey) as position, "
    "cast(sum(n) over (order by n desc, o_custkey rows unbounded preceding) as bigint) as cumulative from c) "
    "select *, round(cumulative / (select sum(n) from c), 6) as share from w",
)
def pareto(spark, sf):
    return rounded(profile.pareto(table(spark, sf, "orders"), "o_custkey"))


@query(
    "P6_repeat_offenders",
    f"with {LOGS} select id, count(*) as trades, sum(is_risk)::bigint as risky, round(sum(is_risk) / count(*), 6) as portion from t group by id "
    "having count(*) > 1 and sum(is_risk) > 0 order by sum(is_risk) / count(*) desc, risky desc, id limit 50",
)
def repeat_offenders(spark, sf):
    risk = profile.risk_per_key(trades(spark, sf), "id", "is_risk").filter("trades > 1 and risky > 0")
    return rounded(risk.orderBy(F.desc("portion"), F.desc("risky"), "id").limit(50))


@query("P6_risk_per_user", f"with {LOGS} select id, count(*) as trades, sum(is_risk)::bigint as risky, round(sum(is_risk) / count(*), 6) as portion from t group by id")
def risk_per_user(spark, sf):
    return rounded(profile.risk_per_key(trades(spark, sf), "id", "is_risk"))


@query("P8_time_range", "select event_type, min(ts) as first, max(ts) as last from events group by 1")
def time_range(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(
    "P9_counts_by_calendar",
    "with e as (select ts from events) select part, value, count(*) as n from (select 'day' as part, day(ts) as value from e union all select 'hour', hour(ts) from e "
    "union all select 'month', month(ts) from e union all select 'weekday', isodow(ts) - 1 from e) group by all",
)
def counts_by_calendar(spark, sf):
    parts = S.calendar_parts(F.col("ts").cast("timestamp"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("value")) for n, c in parts.items()])).alias("p")
    return profile.value_counts(table(spark, sf, "events").select(rows).select("p.*"), "part", "value")


@query(
    "P10_label_odds",
    f"with {LOGS}, c as (select hour(time) as bucket, count(*) filter (where is_risk = 0) as negatives, count(*) filter (where is_risk = 1) as positives "
    "from t where day(time) <> 18 group by 1) select *, round(case when negatives > 0 then positives / negatives end, 6) as odds from c",
)
def label_odds(spark, sf):
    kept = trades(spark, sf).filter(F.dayofmonth("time") != 18)
    return rounded(profile.label_odds(kept, F.hour("time"), "is_risk"))


@query(
    "P10_label_odds_by_day",
    f"with {LOGS}, c as (select day(time) as bucket, count(*) filter (where is_risk = 0) as negatives, count(*) filter (where is_risk = 1) as positives "
    "from t group by 1) select *, round(case when positives > 0 then negatives / positives end, 6) as odds from c",
)
def label_odds_by_day(spark, sf):
    return rounded(profile.label_odds(trades(spark, sf), F.dayofmonth("time"), "is_risk", positive_over_negative=False))


@query("P11_key_duplication", "select count(*) as rows, count(distinct l_orderkey) as keys from lineitem")
def key_duplication(spark, sf):
    return profile.duplication(table(spark, sf, "lineitem"), "l_orderkey")


def _cardinality(name: str, a: str, b: str) -> None:
    @query(
        name,
        f"with {LOGS}, c as (select {a}, count(*) as n from (select distinct {a}, {b} from l) group by all) "
        "select count(*) as keys, sum(n)::bigint as pairs, (sum(n) - count(*))::bigint as excess, max(n) as most, round(avg(n), 6) as mean from c",
    )
    def cardinality(spark, sf):
        return rounded(profile.attribute_cardinality(logins(spark, sf), a.split(", "), b.split(", ")))


_cardinality("P12_devices_per_user", "id", "device")
_cardinality("P12_users_per_device", "device", "id")
_cardinality("P12_city_of_ip", "ip", "city")
_cardinality("P12_users_per_device_and_source", "device, log_from", "id")


@query("P13_value_combinations", f"with {LOGS} select result, type, log_from, count(*) as n from l group by all")
def value_combinations(spark, sf):
    return profile.value_counts(logins(spark, sf), "result", "type", "log_from")


_CHECKED = ("timelong_login_0", "timelong_login_1", "timelong_login_2", "city_login_2")


def _checked(spark, sf):
    linked = link_last_events(logins(spark, sf), trades(spark, sf).select("rowkey", "id", "us"), ["timelong", "city"], 3)
    return recent_details(linked, ["timelong", "city"]).select("rowkey", *_CHECKED)


_CHECKED_SQL = (
    f"with {LOGS}, r as (select t.rowkey, l.timelong, l.city, row_number() over (partition by t.rowkey order by l.us desc, l.log_id desc) as n from t join l on l.id = t.id and l.us < t.us), "
    "w as (select t.rowkey, max(timelong) filter (where n = 1) as timelong_login_0, max(timelong) filter (where n = 2) as timelong_login_1, "
    "max(timelong) filter (where n = 3) as timelong_login_2, max(city) filter (where n = 3) as city_login_2 from t left join r using (rowkey) group by 1) "
)


@query(
    "P14_completeness",
    _CHECKED_SQL
    + " union all ".join(
        f"select '{c}' as \"column\", round(avg(cast(coalesce({c}, -10) = -10 as int)), 6) as emptiness, count(*) filter (where {c} is null) as nulls from w" for c in _CHECKED
    ),
)
def completeness(spark, sf):
    checked = _checked(spark, sf)
    filled = profile.completeness(checked.fillna(S.MISSING), _CHECKED).drop("nulls")
    return rounded(filled.join(profile.completeness(checked, _CHECKED).drop("emptiness"), "column"))


_RATIOS = {
    "plain": "l_quantity",
    "ratio": "case when l_tax = 0 and l_discount = 0 then cast('nan' as double) when l_tax = 0 then cast('infinity' as double) else l_discount / l_tax end",
    "negated": "case when l_tax = 0 then cast('-infinity' as double) else -l_discount / l_tax end",
}


@query(
    "P15_not_finite",
    "with r as (select " + ", ".join(f"{e} as {n}" for n, e in _RATIOS.items()) + " from lineitem) "
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) filter (where isnan({c})) as nans, count(*) filter (where {c} = cast('infinity' as double)) as infinite, "
        f"count(*) filter (where {c} = cast('-infinity' as double)) as minus_infinite from r" for c in _RATIOS
    ),
)
def not_finite(spark, sf):
    lines = table(spark, sf, "lineitem")
    zero_tax = F.col("l_tax") == 0
    ratio = F.try_divide(F.col("l_discount"), F.col("l_tax"))
    both = zero_tax & (F.col("l_discount") == 0)
    columns = lines.select(
        F.col("l_quantity").alias("plain"),
        F.when(both, float("nan")).when(zero_tax, float("inf")).otherwise(ratio).alias("ratio"),
        F.when(zero_tax, float("-inf")).otherwise(-ratio).alias("negated"),
    )
    return profile.not_finite(columns, list(_RATIOS))


_TYPED = {"o_orderstatus": "string", "o_orderpriority": "string", "o_custkey": "bigint", "o_totalprice": "double"}


@query(
    "P16_column_types",
    " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as distinct_values, '{t}' as type from orders" for c, t in _TYPED.items()),
)
def column_types(spark, sf):
    return profile.column_types(table(spark, sf, "orders"), list(_TYPED))


@query(
    "P17_distribution_per_class",
    "select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.05), 6) as q05, round(quantile_cont(l_extendedprice, 0.25), 6) as q25, "
    "round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.75), 6) as q75, round(quantile_cont(l_extendedprice, 0.95), 6) as q95 from lineitem group by 1",
)
def distribution_per_class(spark, sf):
    lines = table(spark, sf, "lineitem")
    qs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    spread = profile.quantiles(lines, "l_extendedprice", qs, ["l_returnflag"])
    return rounded(profile.value_counts(lines, "l_returnflag").join(spread, "l_returnflag"))
