"""Scans, sinks, and the shaping of rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, logins, rounded, table, trades
from priorsight.functions import scalars as S
from priorsight.operators.families import value_statistics
from priorsight.operators.history import trailing_counts
from priorsight.plans.ordering import attach_row
from priorsight.sources import files


@query(
    "A1_csv_scan",
    f"with {LOGS} select cast(rowkey as varchar) as rowkey, cast(id as varchar) as id, strftime(time, '%Y-%m-%d %H:%M:%S') as time, is_risk from t",
)
def csv_scan(spark, sf):
    path = files.scratch_path(spark, "trades-csv")
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time")
    files.write_csv(trades(spark, sf).select("rowkey", "id", text, "is_risk"), path)
    return files.read_csv(spark, path, files.TRADE_SCHEMA)


_SPOILT = "case when rowkey % 97 = 0 then 'does not fit: is_risk' when rowkey % 89 = 0 then 'does not fit: hour, is_risk' end"


@query(
    "A1_csv_quarantine",
    f"with {LOGS}, m as (select {_SPOILT} as reason from t) select coalesce(reason, 'fits') as reason, count(*) as n from m group by 1",
)
def csv_quarantine(spark, sf):
    """Records in which one or two numbers are words are kept apart, each with its reason; the others go on."""
    path = files.scratch_path(spark, "spoilt-csv")
    first, second = F.col("rowkey") % 97 == 0, F.col("rowkey") % 89 == 0
    risk = F.when(first | second, "yes").otherwise(F.col("is_risk").cast("string")).alias("is_risk")
    hour = F.when(second & ~first, "noon").otherwise(F.hour("time").cast("string")).alias("hour")
    files.write_csv(trades(spark, sf).select(F.col("rowkey").cast("string").alias("rowkey"), hour, risk), path)
    schema = T.StructType([T.StructField("is_risk", T.IntegerType()), T.StructField("rowkey", T.LongType()), T.StructField("hour", T.IntegerType())])
    good, bad = files.read_csv_apart(spark, path, schema)
    return good.select(F.lit("fits").alias("reason")).union(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A2_json_quarantine",
    "select case when p_partkey % 50 = 0 then 'is no JSON' when p_partkey % 70 = 0 then 'does not fit: price' else 'fits' end as reason, count(*) as n from part group by 1",
)
def json_quarantine(spark, sf):
    path = files.scratch_path(spark, "spoilt-json")
    price = F.when(F.col("listing_id") % 70 == 0, F.lit("cheap")).otherwise(F.col("price").cast("string"))
    quote = F.when(F.col("listing_id") % 70 == 0, F.lit('"')).otherwise("")
    line = F.concat(F.lit('{"listing_id": '), F.col("listing_id"), F.lit(', "price": '), quote, price, quote, F.when(F.col("listing_id") % 50 == 0, "").otherwise("}"))
    _listings(spark, sf).select(line.alias("value")).write.text(path)
    good, bad = files.read_json_apart(spark, path, files.LISTING_SCHEMA)
    return good.select(F.lit("fits").alias("reason")).union(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_LISTINGS = """select p_partkey as listing_id, case when p_retailprice < 1000 then 'low' when p_retailprice < 1500 then 'medium' else 'high' end as interest_level,
    p_retailprice as price, p_size as bedrooms, string_split(p_name || ' ' || p_type, ' ') as features from part"""


def _listings(spark, sf):
    price = F.col("p_retailprice")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("listing_id"),
        F.when(price < 1000, "low").when(price < 1500, "medium").otherwise("high").alias("interest_level"),
        price.alias("price"), F.col("p_size").alias("bedrooms"),
        F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("features"),
    )


@query("A2_json_scan", _LISTINGS)
def json_scan(spark, sf):
    path = files.scratch_path(spark, "listings-json")
    files.write_json(_listings(spark, sf), path)
    return files.read_json(spark, path, files.LISTING_SCHEMA).select("listing_id", "interest_level", "price", "bedrooms", "features")


def _store(spark, sf):
    store = files.scratch_path(spark, "features")
    log, asked = logins(spark, sf), trades(spark, sf)
    one = {"logins": F.lit(1).cast("long"), "failures": (F.col("result") < 0).cast("long")}
    files.write_features(trailing_counts(log, asked.select("rowkey", "id", "us"), (30, 7), measures=one).drop("id", "us"), store, "logins")
    files.write_features(asked.select("rowkey", "period", "amount", "is_risk"), store, "trades")
    return store


@query("A3_feature_store_write", f"with {LOGS} select rowkey, period, amount, is_risk from t")
def feature_store_write(spark, sf):
    return spark.read.parquet(_store(spark, sf) + "/trades")


@query(
    "A4_assemble_feature_sets",
    f"with {LOGS} select t.rowkey, t.period, t.amount, count(l.us) filter (where t.us - l.us < 7 * 86400000000) as logins_7, "
    "count(l.us) filter (where t.us - l.us < 30 * 86400000000 and l.result < 0) as failures_30 "
    "from t left join l on l.id = t.id and l.us < t.us group by t.rowkey, t.period, t.amount",
)
def assemble_feature_sets(spark, sf):
    sets = {"trades": ["period", "amount"], "logins": ["logins_7", "failures_30"]}
    return files.assemble(spark, _store(spark, sf), sets)


@query(
    "A4_assemble_buckets",
    f"with {LOGS} select t.rowkey, t.period, t.amount, count(l.us) filter (where t.us - l.us < 7 * 86400000000) as logins_7, "
    "count(l.us) filter (where t.us - l.us < 30 * 86400000000 and l.result < 0) as failures_30 "
    "from t left join l on l.id = t.id and l.us < t.us group by t.rowkey, t.period, t.amount",
)
def assemble_buckets(spark, sf):
    store = files.scratch_path(spark, "buckets")
    log, asked = logins(spark, sf), trades(spark, sf)
    one = {"logins": F.lit(1).cast("long"), "failures": (F.col("result") < 0).cast("long")}
    files.write_bucketed(trailing_counts(log, asked.select("rowkey", "id", "us"), (30, 7), measures=one).drop("id", "us"), store, "logins", buckets=8)
    files.write_bucketed(asked.select("rowkey", "period", "amount", "is_risk"), store, "trades", buckets=8)
    return files.assemble_bucketed(spark, store, {"trades": ["period", "amount"], "logins": ["logins_7", "failures_30"]}, buckets=8)


@query("A5_csv_sink", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_sink(spark, sf):
    path = files.scratch_path(spark, "orders-csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    files.write_csv(orders, path)
    return files.read_csv(spark, path, orders.schema)


@query("A6_score_sink", f"with {LOGS} select rowkey, cast(amount / 500 > 0.5 as int) as is_risk from t")
def score_sink(spark, sf):
    path = files.scratch_path(spark, "scores")
    files.write_scores(trades(spark, sf).withColumn("is_risk", S.above(F.col("amount") / 500, 0.5)), path)
    schema = T.StructType([T.StructField("rowkey", T.LongType()), T.StructField("is_risk", T.IntegerType())])
    return spark.read.schema(schema).csv(path, header=False)


@query("A7_json_sink", "select c_custkey, c_name, c_acctbal from customer")
def json_sink(spark, sf):
    path = files.scratch_path(spark, "customers-json")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_json(customers, path)
    return files.read_json(spark, path, customers.schema)


def _halves(spark, sf):
    log = trades(spark, sf).select("rowkey", "id", "time", "is_risk")
    early = F.dayofmonth("time") <= 20
    return log.filter(early), log.filter(~early)


@query("B1_tag_and_union", f"with {LOGS} select rowkey, id, case when day(time) <= 20 then 'train' else 'test' end as \"from\" from t")
def tag_and_union(spark, sf):
    train, test = _halves(spark, sf)
    return files.tag_and_union(train, test).drop("time")


@query("B2_split_and_check", f"with {LOGS} select count(*) as n, 0 as differing from t where day(time) <= 20")
def split_and_check(spark, sf):
    train, test = _halves(spark, sf)
    both = files.tag_and_union(train, test, keep_label=True)
    again = both.filter(F.col("from") == "train").drop("from")
    differing = files.differences(train, again).agg(F.count(F.lit(1)).alias("differing"))
    return attach_row(again.agg(F.count(F.lit(1)).alias("n")), differing)


@query("B3_parse_time", "select event_id, date_trunc('second', ts) as time from events")
def parse_time(spark, sf):
    text = F.col("ts").cast("string")
    return table(spark, sf, "events").select("event_id", S.parse_time(text).alias("time"))


@query(
    "B4_epoch_mismatch",
    "select count(*) as n, count(*) filter (where make_timestamp(epoch_us(ts) // 1000000 * 1000000) <> ts) as mismatches from events",
)
def epoch_mismatch(spark, sf):
    time = F.col("ts").cast("timestamp")
    back = S.epoch_time(F.unix_seconds(time))
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(back != time).alias("mismatches"))


@query(
    "B5_suffixed_projection",
    f"with {LOGS} select log_id as log_id_login_0, device as device_login_0, timelong as timelong_login_0 from l",
)
def suffixed_projection(spark, sf):
    kept = logins(spark, sf).drop("period", "is_scan").select("log_id", "device", "timelong")
    return kept.select(*[F.col(c).alias(f"{c}_login_0") for c in kept.columns])


@query(
    "B6_calendar_ranges",
    "select o_orderkey, o_orderdate from orders where month(o_orderdate) between 2 and 5 and day(o_orderdate) <> 18 "
    "and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-07-01'",
)
def calendar_ranges(spark, sf):
    at = F.col("o_orderdate")
    return table(spark, sf, "orders").filter(
        (at >= F.lit("1996-01-01").cast("timestamp_ntz")) & (at < F.lit("1998-07-01").cast("timestamp_ntz"))
        & F.month(at).between(2, 5) & (F.dayofmonth(at) != 18)
    ).select("o_orderkey", "o_orderdate")


_GAPPY = f"with {LOGS}, g as (select rowkey, period, case when amount > 10 then amount end as amount, (select max(l.timelong) - 50000 from l where l.id = t.id and l.us < t.us) as longest from t) "


def _gappy(spark, sf):
    asked = trades(spark, sf)
    events = logins(spark, sf).select("id", "us", F.col("timelong").alias("code"))
    longest = value_statistics(events, asked.select("rowkey", "id", "us"), (100,), lambda c: c.cast("double"))
    kept = longest.select("rowkey", (F.col("max_100") - 50_000).alias("longest"))
    return asked.select("rowkey", "period", F.when(F.col("amount") > 10, F.col("amount")).alias("amount")).join(kept, "rowkey")


@query("B7_fill_and_clamp", _GAPPY + "select rowkey, coalesce(amount, -10) as amount, cast(coalesce(case when longest < 0 then -1 else longest end, -10) as double) as longest from g")
def fill_and_clamp(spark, sf):
    gappy = _gappy(spark, sf).withColumn("longest", S.clamp_negative(F.col("longest")))
    return gappy.fillna(S.MISSING, ["amount", "longest"]).drop("period")


@query("B8_marker_to_null", _GAPPY + "select rowkey, amount, period from g where amount is not null and period <> 4")
def marker_to_null(spark, sf):
    filled = _gappy(spark, sf).fillna(S.MISSING, ["amount"]).drop("longest")
    back = filled.withColumn("amount", S.null_if_missing(F.col("amount"))).replace({4: None}, subset=["period"])
    return back.na.drop(subset=["amount", "period"])


@query("B9_distinct_rows", f"with {LOGS} select distinct device, city, log_from from l")
def distinct_rows(spark, sf):
    return logins(spark, sf).select("device", "city", "log_from").distinct()


@query("B11_top_rows", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
def top_rows(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query(
    "B11_nth_value",
    "select o_custkey, n from (select o_custkey, count(*) as n, row_number() over (order by count(*) desc, o_custkey) as place from orders group by 1) where place = 50",
)
def nth_value(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "o_custkey").offset(49).limit(1)


@query(
    "B12_label_pivot",
    f"with {LOGS} select day(time) as day, count(*) filter (where is_risk = 0) as safe, count(*) filter (where is_risk = 1) as risky from t group by 1",
)
def label_pivot(spark, sf):
    counted = trades(spark, sf).groupBy(F.dayofmonth("time").alias("day")).pivot("is_risk", [0, 1]).count()
    return counted.fillna(0).withColumnsRenamed({"0": "safe", "1": "risky"})


@query(
    "B13_frequent_list_values",
    f"with p as ({_LISTINGS}), v as (select unnest(features) as feature from p) select feature, count(*) as n from v group by 1 having count(*) > 0.1 * (select count(*) from p)",
)
def frequent_list_values(spark, sf):
    listings = _listings(spark, sf)
    total = listings.agg(F.count(F.lit(1)).alias("rows"))
    counts = listings.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return attach_row(counts, total).filter(F.col("n") > 0.1 * F.col("rows")).drop("rows")


@query(
    "B13_frequent_words",
    "with v as (select unnest(string_split(text, ' ')) as word from documents) select word, count(*) as n from v group by 1 "
    "having count(*) > 0.1 * (select count(*) from documents)",
)
def frequent_words(spark, sf):
    documents = table(spark, sf, "documents").select("text")
    total = documents.agg(F.count(F.lit(1)).alias("rows"))
    counts = documents.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return attach_row(counts, total).filter(F.col("n") > 0.1 * F.col("rows")).drop("rows")


@query(
    "B14_blocks_side_by_side",
    "select o_orderkey, o_custkey, l.lines, round(l.revenue, 2) as revenue from orders left join "
    "(select l_orderkey, count(*) as lines, sum(l_extendedprice) as revenue from lineitem group by 1) l on l_orderkey = o_orderkey",
)
def blocks_side_by_side(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("revenue")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return rounded(files.beside([orders, lines], "o_orderkey"), 2)


@query(
    "B10_named_window_columns",
    f"with {LOGS} select t.rowkey, "
    + ", ".join(f"count(l.us) filter (where t.us - l.us < {d} * 86400000000 and l.period = 3) as morning_{d}" for d in (15, 3))
    + " from t left join l on l.id = t.id and l.us < t.us group by 1",
)
def named_window_columns(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    measures = {"morning": (F.col("period") == 3).cast("long")}
    return trailing_counts(logins(spark, sf), asked, (15, 3), measures=measures).drop("id", "us")
