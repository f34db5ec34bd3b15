"""Samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, rounded, table, trades
from priorsight.operators import splits


def _unit(key: str, salt: str) -> str:
    return f"(cast('0x' || substr(md5('{salt}' || cast({key} as varchar)), 1, 13) as bigint) / 4503599627370496.0)"


# Training weeks of January against the week after, as months would be in a longer log.
_FOLDS = (((1, 2), 3), ((2, 3), 4))
_WEEK = "cast((day(time) - 1) // 7 as int)"


def _folds_sql() -> str:
    parts = []
    for i, ((first, last), validation) in enumerate(_FOLDS):
        for role, where in (("train", f"w between {first} and {last}"), ("validation", f"w = {validation}")):
            parts.append(
                f"select rowkey, (cast(ceil(3 * row_number() over (order by {_unit('rowkey', f'{role}{i}')}, rowkey) / count(*) over ()) as int) - 1) * 2 + {i} as fold, "
                f"'{role}' as role from p where {where}"
            )
    return f"with {LOGS}, p as (select rowkey, {_WEEK} as w from t) " + " union all ".join(parts)


def week(time: str = "time"):
    return F.floor((F.dayofmonth(time) - 1) / 7).cast("int")


@query("S1_temporal_folds", _folds_sql())
def temporal_folds(spark, sf):
    return splits.temporal_folds(trades(spark, sf), week(), _FOLDS, "rowkey")


@query(
    "S2_certain_part",
    "with n as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as p, count(*) over () as n from orders) select o_orderkey from n where p > n * 1 // 3 and p <= n * 2 // 3",
)
def certain_part(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    return splits.certain_part(orders, ["o_orderdate", "o_orderkey"], 2, 3).select("o_orderkey")


@query("S3_shuffled_folds", f"with {LOGS} select rowkey, cast(floor({_unit('rowkey', 'fold')} * 5) as int) as fold from t")
def shuffled_folds(spark, sf):
    return splits.shuffled_folds(trades(spark, sf).select("rowkey"), "rowkey")


@query(
    "S4_rebalanced",
    f"with {LOGS}, g as (select rowkey, row_number() over (order by rowkey) as place, count(*) over () as n from t where is_risk = 0), "
    "d as (select i as draw from generate_series(0, 4 * (select count(*) from t where is_risk = 1) - 1) r(i)) "
    "select rowkey, 1 as is_risk, c as draw from t, (values (0), (1)) v(c) where is_risk = 1 union all "
    f"select g.rowkey, 0, d.draw from d join g on g.place = cast(floor({_unit('d.draw', 'resample')} * g.n) as bigint) + 1",
)
def rebalanced(spark, sf):
    return splits.rebalanced(trades(spark, sf).select("rowkey", "is_risk"), "is_risk", "rowkey")


@query(
    "S5_undersampled",
    f"with {LOGS}, n as (select rowkey, is_risk, row_number() over (order by {_unit('rowkey', 'under')}, rowkey) as place from t where is_risk = 0) "
    "select rowkey, is_risk from t where is_risk = 1 union all select rowkey, is_risk from n where place <= (select count(*) from t where is_risk = 1)",
)
def undersampled(spark, sf):
    return splits.undersampled(trades(spark, sf).select("rowkey", "is_risk"), "is_risk", "rowkey")


@query(
    "S6_class_weights",
    f"with {LOGS}, c as (select count(*) as n, sum(is_risk) as p from t) select rowkey, cast(case when is_risk = 1 then 10 else 1 end as double) as fixed, "
    "round(case when is_risk = 1 then n / (2 * p) else n / (2 * (n - p)) end, 6) as balanced from t, c",
)
def class_weights(spark, sf):
    log = trades(spark, sf).select("rowkey", "is_risk")
    both = splits.class_weights(splits.class_weights(log, "is_risk", 10, "fixed"), "is_risk", None, "balanced")
    return rounded(both.drop("is_risk"))


@query("S7_random_split", f"with {LOGS} select rowkey, {_unit('rowkey', 'split')} < 0.8 as in_train from t")
def random_split(spark, sf):
    train, test = splits.random_split(trades(spark, sf).select("rowkey"), "rowkey")
    return train.withColumn("in_train", F.lit(True)).unionByName(test.withColumn("in_train", F.lit(False)))


@query("S8_period_selection", f"with {LOGS} select rowkey, case when {_WEEK} between 1 and 2 then 'train' else 'test' end as role from t where {_WEEK} between 1 and 3")
def period_selection(spark, sf):
    dated = trades(spark, sf).select("rowkey", week().alias("w")).filter(F.col("w").between(1, 3))
    return dated.select("rowkey", F.when(F.col("w") <= 2, "train").otherwise("test").alias("role"))
