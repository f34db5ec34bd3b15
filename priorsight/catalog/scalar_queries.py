"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, logins, rounded, table, trades
from priorsight.functions import scalars as S


@query(
    "C1_calendar_parts",
    "select event_id, month(ts) as month, day(ts) as day, isodow(ts) - 1 as weekday, hour(ts) as hour from events",
)
def calendar_parts(spark, sf):
    parts = S.calendar_parts(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "C2_shifted_cycles",
    "select event_id, case when day(ts) + 15 < 31 then day(ts) + 15 else day(ts) - 15 end as day_cycle, "
    "case when isodow(ts) + 2 < 7 then isodow(ts) + 2 else isodow(ts) - 4 end as weekday_cycle, "
    "case when hour(ts) + 12 < 23 then hour(ts) + 12 else hour(ts) - 12 end as hour_cycle from events",
)
def shifted_cycles(spark, sf):
    p = S.calendar_parts(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        "event_id", S.day_cycle(p["day"]).alias("day_cycle"), S.weekday_cycle(p["weekday"]).alias("weekday_cycle"),
        S.hour_cycle(p["hour"]).alias("hour_cycle"),
    )


@query(
    "C3_day_period",
    "select event_id, case when hour(ts) in (0, 18, 19, 20, 21, 22, 23) then 0 when hour(ts) in (15, 16, 17) then 1 "
    "when hour(ts) in (12, 13, 14) then 2 when hour(ts) between 8 and 11 then 3 else 4 end as period from events",
)
def day_period(spark, sf):
    return table(spark, sf, "events").select("event_id", S.day_period(F.hour(F.col("ts").cast("timestamp"))).alias("period"))


@query(
    "C4_weekend_flags",
    "select o_orderkey, day(o_orderdate) in (6, 7) as day_six_or_seven, isodow(o_orderdate) = 7 as sunday, "
    "isodow(o_orderdate) >= 6 as weekend from orders",
)
def weekend_flags(spark, sf):
    time = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        "o_orderkey", S.is_sixth_or_seventh_of_month(time).alias("day_six_or_seven"),
        S.is_sunday_code(F.weekday(time)).alias("sunday"), S.is_weekend(time).alias("weekend"),
    )


@query(
    "C5_month_part",
    "select o_orderkey, case when day(o_orderdate) < 7 then 0 when day(o_orderdate) < 15 then 1 when day(o_orderdate) < 22 then 2 else 3 end as part from orders",
)
def month_part(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.month_part(F.dayofmonth("o_orderdate")).alias("part"))


@query(
    "C6_distance_to_whole_second",
    f"with {LOGS} select log_id, least(timelong % 1000, 1000 - timelong % 1000) as off_second from l",
)
def distance_to_whole_second(spark, sf):
    return logins(spark, sf).select("log_id", S.distance_to_whole_second(F.col("timelong")).alias("off_second"))


@query(
    "C7_logarithms",
    f"with {LOGS} select log_id, round(ln(timelong + 1), 6) as log_one, case when timelong > 0 then round(ln(timelong), 6) end as log_plain from l",
)
def logarithms(spark, sf):
    t = F.col("timelong")
    return rounded(logins(spark, sf).select("log_id", S.offset_log(t).alias("log_one"), F.ln(t).alias("log_plain")))


@query(
    "C8_composite_keys",
    f"with {LOGS} select coalesce(cast(ip as varchar), 'nan') || '|' || coalesce(cast(case when device % 7 > 0 then device end as varchar), 'nan') as pair, count(*) as n from l group by 1",
)
def composite_keys(spark, sf):
    device = F.when(F.col("device") % 7 > 0, F.col("device"))
    pair = S.composite_key(F.col("ip"), device).alias("pair")
    return logins(spark, sf).groupBy(pair).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C9_epsilon_ratio",
    "select l_orderkey, l_linenumber, l_partkey, round((l_extendedprice + 1e-7) / (l_quantity + l_tax + 1e-7), 4) as ratio from lineitem",
)
def epsilon_ratio(spark, sf):
    ratio = S.epsilon_ratio(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")).alias("ratio")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio), 4)


@query("C10_columns_by_name", "select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice from lineitem")
def columns_by_name(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(*S.named_like(lines.columns, "key", "number", "date", "price")).drop("l_suppkey")


@query(
    "C11_threshold_and_blend",
    f"with {LOGS} select rowkey, cast(amount / 500 > 0.2 as int) as label, round(0.3 * amount / 500 + 0.7 * period / 4, 6) as blended from t",
)
def threshold_and_blend(spark, sf):
    a, b = F.col("amount") / 500, F.col("period") / 4
    return rounded(trades(spark, sf).select("rowkey", S.above(a, 0.2).alias("label"), S.blend([a, b], [0.3, 0.7]).alias("blended")))
