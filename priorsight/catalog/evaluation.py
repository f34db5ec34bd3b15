"""Metrics of a score that needs no model: the scaled amount of the trade's calendar neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, rounded, trades
from priorsight.operators import metrics, splits

# A score with ties that is only partly right about the label.
_SCORED = f"{LOGS}, s as (select rowkey, is_risk, round(least(amount / 250, 1) * 0.5 + (rowkey % 10) / 20, 2) as score, rowkey % 5 as fold from t)"


def scored(spark, sf):
    score = F.round(F.least(F.col("amount") / 250, F.lit(1.0)) * 0.5 + (F.col("rowkey") % 10) / 20, 2)
    return trades(spark, sf).select("rowkey", "is_risk", score.alias("score"), (F.col("rowkey") % 5).alias("fold"))


_CELLS = "count(*) filter (where is_risk = 1 and score > {t}) as tp, count(*) filter (where is_risk = 0 and score > {t}) as fp, count(*) filter (where is_risk = 1 and not score > {t}) as fn, count(*) filter (where is_risk = 0 and not score > {t}) as tn"


@query(
    "M11_f_beta",
    f"with {_SCORED}, c as (select fold, {_CELLS.format(t=0.5)} from s group by 1) select fold, round(1.01 * tp / (1.01 * tp + 0.01 * fn + fp), 6) as f_beta from c",
)
def f_beta(spark, sf):
    return rounded(scored(spark, sf).groupBy("fold").agg(metrics.f_beta(F.col("is_risk"), F.col("score")).alias("f_beta")))


_THRESHOLDS = (0.2, 0.4, 0.5, 0.6, 0.8)


@query(
    "M12_threshold_sweep",
    f"with {_SCORED}, c as ("
    + " union all ".join(f"select cast({t} as double) as threshold, {_CELLS.format(t=t)} from s" for t in _THRESHOLDS)
    + ") select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, "
    "round(coalesce(1.01 * tp / nullif(1.01 * tp + 0.01 * fn + fp, 0), 0), 6) as f_beta from c",
)
def threshold_sweep(spark, sf):
    return rounded(metrics.threshold_sweep(scored(spark, sf), "is_risk", "score", _THRESHOLDS))


@query(
    "M13_roc_auc",
    f"with {_SCORED} select round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end), 6) as auc from s a, s b where a.is_risk = 1 and b.is_risk = 0",
)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(scored(spark, sf), "is_risk", "score"))


@query(
    "M13_roc_auc_by_group",
    f"with {_SCORED} select a.fold, h.hour, round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end), 6) as auc from "
    "(select *, hour(time) as hour from s join t using (rowkey, is_risk)) a join (select distinct hour(time) as hour from t) h on h.hour = a.hour "
    "join (select *, hour(time) as hour from s join t using (rowkey, is_risk)) b on a.fold = b.fold and b.hour = a.hour and b.is_risk = 0 where a.is_risk = 1 group by 1, 2",
)
def roc_auc_by_group(spark, sf):
    rows = scored(spark, sf).join(trades(spark, sf).select("rowkey", F.hour("time").cast("long").alias("hour")), "rowkey")
    return rounded(metrics.roc_auc_by(rows, "is_risk", "score", ["fold", "hour"]).filter("auc is not null").select("fold", "hour", "auc"))


@query("M14_confusion", f"with {_SCORED} select is_risk as label, cast(score > 0.5 as int) as predicted, count(*) as n from s group by 1, 2")
def confusion(spark, sf):
    return metrics.confusion(scored(spark, sf), "is_risk", "score")


@query(
    "M15_score_counts",
    f"with {_SCORED} " + " union all ".join(f"select cast({t} as double) as cut, count(*) filter (where score > {t}) as n from s" for t in _THRESHOLDS),
)
def score_counts(spark, sf):
    return metrics.score_counts(scored(spark, sf), "score", _THRESHOLDS)


@query(
    "M17_blended_labels",
    f"with {_SCORED} select rowkey, round(0.3 * score + 0.7 * (1 - score) * fold / 4, 6) as blended, cast(0.3 * score + 0.7 * (1 - score) * fold / 4 > 0.35 as int) as is_risk from s",
)
def blended_labels(spark, sf):
    from priorsight.functions.scalars import above, blend

    mixed = blend([F.col("score"), (1 - F.col("score")) * F.col("fold") / 4], [0.3, 0.7])
    return rounded(scored(spark, sf).select("rowkey", mixed.alias("blended"), above(mixed, 0.35).alias("is_risk")))
