"""How the shared ``events`` table plays the part of the login and the trade log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from priorsight.functions.scalars import day_period, micros

DAYS = (30, 15, 7, 3, 1)
HABIT_DAYS = (30, 7)
VALUE_DAYS = (30, 15, 7)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def logins(spark: SparkSession, sf: str) -> DataFrame:
    """Login log: every event that is not a purchase."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf, "events").filter("event_type <> 'purchase'")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("id"),
        F.col("ts").cast("timestamp").alias("time"),
        micros(F.col("ts")).alias("us"),
        F.round(F.col("value") * 1000).cast("long").alias("timelong"),
        k.alias("device"),
        (k % 25).alias("ip"),
        (k % 10).alias("city"),
        F.expr("case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 10 else 21 end").alias("log_from"),
        F.when(F.col("event_type") == "error", F.when(k % 2 == 0, -1).otherwise(-2))
        .when(F.col("event_type") == "signup", 31).otherwise(1).alias("result"),
        (k % 3 + 1).alias("type"),
        (k % 2).alias("is_scan"),
        day_period(F.hour(F.col("ts").cast("timestamp"))).alias("period"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trade log: the purchases."""
    events = table(spark, sf, "events").filter("event_type = 'purchase'")
    return events.select(
        F.col("event_id").alias("rowkey"),
        F.col("user_id").alias("id"),
        F.col("ts").cast("timestamp").alias("time"),
        micros(F.col("ts")).alias("us"),
        (F.col("value") > 100).cast("int").alias("is_risk"),
        F.col("value").alias("amount"),
        day_period(F.hour(F.col("ts").cast("timestamp"))).alias("period"),
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since the order of addition differs between engines."""
    return df.select(
        *[
            F.round(f.name, places).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


_PERIOD = "case when h = 0 or h > 17 then 0 when h > 14 then 1 when h > 11 then 2 when h > 7 then 3 else 4 end"

LOGS = f"""ev as (select event_id, user_id, event_type, value, ts, epoch_us(ts) as us, hour(ts) as h,
    cast(json_extract_string(props, '$.k') as int) as k from events),
l as (select event_id as log_id, user_id as id, ts as time, us, cast(round(value * 1000) as bigint) as timelong,
    k as device, k % 25 as ip, k % 10 as city,
    case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 10 else 21 end as log_from,
    case when event_type = 'error' then case when k % 2 = 0 then -1 else -2 end
         when event_type = 'signup' then 31 else 1 end as result,
    k % 3 + 1 as type, k % 2 as is_scan, {_PERIOD} as period from ev where event_type <> 'purchase'),
t as (select event_id as rowkey, user_id as id, ts as time, us, cast(value > 100 as int) as is_risk,
    value as amount, {_PERIOD} as period from ev where event_type = 'purchase')"""

DAY = "86400000000"


def within(d: int, gap: str = "gap") -> str:
    return f"{gap} < {d} * {DAY}"
