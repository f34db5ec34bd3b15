"""Joins of trades to logins and to their own past."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import DAY, DAYS, LOGS, logins, table, trades
from priorsight.functions.scalars import micros
from priorsight.operators import history

_LAST3 = """r as (select t.rowkey, l.log_id, row_number() over (partition by t.rowkey order by l.us desc, l.log_id desc) as n
    from t join l on l.id = t.id and l.us < t.us),
links as (select t.rowkey, t.id, t.us, t.time, t.is_risk, max(log_id) filter (where n = 1) as recent_login_id_0,
    max(log_id) filter (where n = 2) as recent_login_id_1, max(log_id) filter (where n = 3) as recent_login_id_2
    from t left join r on r.rowkey = t.rowkey group by all)"""


def links(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    linked = history.link_last_events(logins(spark, sf), asked, ["log_id"], 3)
    return linked.select("rowkey", "id", "us", *[F.col(f"last_{i}.log_id").alias(f"recent_login_id_{i}") for i in range(3)])


@query(
    "J1_login_details",
    f"with {LOGS}, {_LAST3} select links.rowkey, "
    + ", ".join(f"l{i}.timelong as timelong_login_{i}, l{i}.device as device_login_{i}, l{i}.city as city_login_{i}" for i in range(3))
    + " from links "
    + " ".join(f"left join l l{i} on l{i}.log_id = recent_login_id_{i}" for i in range(3)),
)
def login_details(spark, sf):
    out = links(spark, sf)
    for i in range(3):
        out = history.attach_details(out, logins(spark, sf), f"recent_login_id_{i}", f"_login_{i}", ["timelong", "device", "city"])
    return out.select("rowkey", *[f"{c}_login_{i}" for i in range(3) for c in ("timelong", "device", "city")])


@query(
    "J2_last_login",
    f"with {LOGS}, {_LAST3} select links.rowkey, l.log_id, l.ip, l.device, l.result from links "
    "left join l on l.log_id = recent_login_id_0",
)
def last_login(spark, sf):
    payload = {c: c for c in ("log_id", "ip", "device", "result")}
    return history.with_last_event(logins(spark, sf), trades(spark, sf), payload).select("rowkey", *payload)


@query(
    "J3_shared_keys",
    "select a.o_orderkey, a.o_custkey, count(*) as lines from orders a join lineitem b on a.o_orderkey = b.l_orderkey group by all",
)
def shared_keys(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query(
    "J4_risk_counts_on_index",
    f"with {LOGS}, c as (select id, count(*) as trade_counts from t group by id), "
    "r as (select id, count(*) as risk_count from t where is_risk = 1 group by id) "
    "select c.id, trade_counts, coalesce(risk_count, 0) as risk_count from c left join r on r.id = c.id",
)
def risk_counts_on_index(spark, sf):
    log = trades(spark, sf)
    counts = log.groupBy("id").agg(F.count(F.lit(1)).alias("trade_counts"))
    risky = log.filter("is_risk = 1").groupBy("id").agg(F.count(F.lit(1)).alias("risk_count"))
    return counts.join(risky, "id", "left").fillna(0, ["risk_count"])


@query(
    "J5_inner_cascade",
    f"with {LOGS}, a as (select id, count(distinct device) as devices from l group by id), "
    "b as (select id, count(*) as failures from l where result <> 1 group by id) "
    "select t.rowkey, t.id, devices, failures from t join a on a.id = t.id join b on b.id = t.id",
)
def inner_cascade(spark, sf):
    log = logins(spark, sf)
    per_user = log.groupBy("id").agg(
        F.count_distinct("device").alias("devices"), F.count_if(F.col("result") != 1).alias("failures")
    ).filter("failures > 0")
    return trades(spark, sf).select("rowkey", "id").join(per_user, "id")


@query(
    "J6_history",
    f"with {LOGS} select t.rowkey, count(l.log_id) as logins_before from t left join l on l.id = t.id and l.us < t.us group by t.rowkey",
)
def history_of_user(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    return history.history_counts(logins(spark, sf), asked, name="logins_before").select("rowkey", "logins_before")


_ORDERS_BEFORE = ", ".join(
    f"count(b.o_orderkey) filter (where epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate) < {d} * {DAY}) as orders_{d}"
    for d in (365, 90, 30)
)


@query(
    "J7_trailing_range_with_ties",
    f"select a.o_orderkey, {_ORDERS_BEFORE} from orders a left join orders b on b.o_custkey = a.o_custkey "
    "and b.o_orderdate < a.o_orderdate group by a.o_orderkey",
)
def trailing_range(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("us"))
    counted = history.trailing_counts(orders.select("o_custkey", "us"), orders, (365, 90, 30), ("o_custkey",), {"orders": F.lit(1).cast("long")})
    return counted.drop("us", "o_custkey")


@query(
    "J7_trailing_range",
    f"with {LOGS} select t.rowkey, "
    + ", ".join(f"count(l.us) filter (where t.us - l.us < {d} * {DAY}) as logins_{d}" for d in DAYS)
    + ", "
    + ", ".join(f"cast(coalesce(sum(l.timelong) filter (where t.us - l.us < {d} * {DAY}), 0) as bigint) as timelong_{d}" for d in DAYS)
    + " from t left join l on l.id = t.id and l.us < t.us group by t.rowkey",
)
def trailing_range_sums(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    measures = {"logins": F.lit(1).cast("long"), "timelong": F.coalesce("timelong", F.lit(0))}
    return history.trailing_counts(logins(spark, sf), asked, DAYS, measures=measures).drop("id", "us")


@query("J8_last_three_logins", f"with {LOGS}, {_LAST3} select rowkey, recent_login_id_0, recent_login_id_1, recent_login_id_2 from links")
def last_three_logins(spark, sf):
    return links(spark, sf).drop("id", "us")


@query(
    "J8_last_orders_with_ties",
    "select a.o_orderkey, max(case when n = 1 then prior end) as prior_0, max(case when n = 2 then prior end) as prior_1 from "
    "(select a.o_orderkey, b.o_orderkey as prior, row_number() over (partition by a.o_orderkey order by b.o_orderdate desc, b.o_orderkey desc) as n "
    "from orders a left join orders b on b.o_custkey = a.o_custkey and b.o_orderdate < a.o_orderdate) a group by a.o_orderkey",
)
def last_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("us"))
    linked = history.link_last_events(orders, orders, [], 2, ("o_custkey",), "o_orderkey")
    return linked.select("o_orderkey", *[F.col(f"last_{i}.event_order").alias(f"prior_{i}") for i in range(2)])


@query(
    "J9_cross_user_history",
    f"with {LOGS}, {_LAST3}, q as (select links.rowkey, links.us, l.device from links left join l on l.log_id = recent_login_id_0) "
    f"select q.rowkey, count(l.us) filter (where q.us - l.us < 7 * {DAY}) as logins_7, "
    f"count(l.us) filter (where q.us - l.us < 7 * {DAY} and l.result < 0) as failures_7 "
    "from q left join l on l.device = q.device and l.us < q.us group by q.rowkey",
)
def cross_user_history(spark, sf):
    log = logins(spark, sf)
    asked = history.with_last_event(log, trades(spark, sf).select("rowkey", "id", "us"), {"device": "device"})
    measures = {"logins": F.lit(1).cast("long"), "failures": (F.col("result") < 0).cast("long")}
    seen = log.filter(F.col("device").isNotNull())
    return history.trailing_counts(seen, asked.drop("id"), (7,), ("device",), measures).drop("device", "us")


@query(
    "J10_past_trades_by_category",
    "select a.o_orderkey, count(b.o_orderkey) as earlier from orders a left join orders b "
    "on b.o_custkey = a.o_custkey and b.o_orderpriority = a.o_orderpriority and b.o_orderdate < a.o_orderdate group by a.o_orderkey",
)
def past_trades_by_category(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", micros(F.col("o_orderdate")).alias("us"))
    keys = ("o_custkey", "o_orderpriority")
    return history.history_counts(orders, orders, keys, "earlier").select("o_orderkey", "earlier")


@query(
    "J11_has_trade",
    f"with {LOGS}, {_LAST3} select log_id, cast(log_id in (select recent_login_id_0 from links where recent_login_id_0 is not null) as int) as has_trade from l",
)
def has_trade(spark, sf):
    return history.flag_linked(logins(spark, sf), links(spark, sf)).select("log_id", "has_trade")


@query(
    "J11_linked_and_unlinked",
    f"with {LOGS}, {_LAST3} select log_id in (select recent_login_id_0 from links where recent_login_id_0 is not null) as linked, "
    "count(*) as n, cast(sum(timelong) as bigint) as timelong from l group by 1",
)
def linked_and_unlinked(spark, sf):
    log, link = logins(spark, sf), links(spark, sf)
    both = history.linked_only(log, link).withColumn("linked", F.lit(True)).unionByName(
        history.unlinked_only(log, link).withColumn("linked", F.lit(False))
    )
    return both.groupBy("linked").agg(F.count(F.lit(1)).alias("n"), F.sum("timelong").alias("timelong"))
