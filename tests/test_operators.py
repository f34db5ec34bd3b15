"""Operators on small hand-made tables."""

import math
import random
from statistics import mean

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from priorsight.functions import scalars
from priorsight.operators import featurestats, links, metrics, models, neighbours, profile, splits
from priorsight.plans import timegrid
from priorsight.plans.ordering import with_global_order
from priorsight.sources import files

DAY = timegrid.DAY_US


def test_global_order_and_running_sums(spark):
    rows = [(i, random.Random(i).randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = with_global_order(df, ["v", "k"], ["v"]).collect()
    total = 0
    for place, (k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += v
        r = next(x for x in got if x["k"] == k)
        assert (r["position"], r["run_v"], r["n_rows"], r["all_v"]) == (place, total, 500, sum(x[1] for x in rows))


def test_quantiles_with_many_copies(spark):
    values = [1.0] * 300 + [float(i) for i in range(100)] + [7.5] * 51
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    row = profile.quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.93}).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.93])))


def test_window_border(spark):
    from priorsight.operators.history import trailing_counts

    t = 1_700_000_000_000_000
    events = spark.createDataFrame([(1, "a", t - DAY), (2, "a", t - DAY + 1), (3, "a", t), (4, "b", t - 1)], "log_id long, id string, us long")
    asked = spark.createDataFrame([(9, "a", t), (8, "c", t)], "rowkey long, id string, us long")
    got = {r["rowkey"]: r["events_1"] for r in trailing_counts(events, asked, (1,)).collect()}
    assert got == {9: 1, 8: 0}


def test_gap_ladder(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (2, 5.0, None, None), (3, 5.0, 6.0, None), (4, 5.0, 6.0, 7.0)],
        "k int, login_distance_0 double, login_distance_1 double, login_distance_2 double",
    ).withColumns({"us": F.lit(100_000_000).cast("long"), "mean_login_distance": F.lit(20.0)})
    got = {r["k"]: [round(math.exp(r[f"login_distance_{i}_al"]), 6) for i in range(3)] for r in links.fill_gaps(df, 0).collect()}
    assert got == {1: [100, 120, 140], 2: [5, 100, 120], 3: [5, 6, 100], 4: [5, 6, 7]}


def test_chi_square_with_two_categories_is_corrected(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, x int, y int")
    o = [[sum(1 for _, x, y in rows if (x, y) == (a, b)) for b in (0, 1)] for a in (0, 1)]
    n = 50
    off = max(0, abs(o[0][0] * o[1][1] - o[0][1] * o[1][0]) - n / 2)
    want = n * off**2 / (sum(o[0]) * sum(o[1]) * (o[0][0] + o[1][0]) * (o[0][1] + o[1][1]))
    assert featurestats.chi_square(df, "x", "y", "k").first()["chi2"] == pytest.approx(want)


def test_box_cox_power(spark):
    r = random.Random(3)
    values = [math.exp(r.gauss(1, 0.5)) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    power = featurestats.fit_box_cox(df, "x")

    def likelihood(p):
        y = [math.log(v) if abs(p) < 1e-9 else (v**p - 1) / p for v in values]
        m = mean(y)
        return (p - 1) * sum(map(math.log, values)) - 200 * math.log(sum((a - m) ** 2 for a in y) / 400)

    best = max((i / 1000 for i in range(-1000, 1000)), key=likelihood)
    assert power == pytest.approx(best, abs=2e-3)


def test_principal_components_are_white(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        a, b = r.gauss(5, 3), r.gauss(-2, 1)
        rows.append((i, a, a + b, b * 2))
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    white, explained = featurestats.principal_components(df, ["a", "b", "c"], "k", 2)
    s = white.agg(F.avg("pc_0").alias("m"), F.stddev_samp("pc_0").alias("d0"), F.stddev_samp("pc_1").alias("d1"), F.corr("pc_0", "pc_1").alias("c")).first()
    assert [s["m"], s["d0"], s["d1"], s["c"]] == pytest.approx([0, 1, 1, 0], abs=1e-6)
    assert sum(explained) == pytest.approx(1.0, abs=1e-6)


def test_resampling_sizes(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "rowkey int, is_risk int")
    counts = {r["is_risk"]: r["count"] for r in splits.rebalanced(df, "is_risk", "rowkey").groupBy("is_risk").count().collect()}
    assert counts == {1: 40, 0: 80}
    under = {r["is_risk"]: r["count"] for r in splits.undersampled(df, "is_risk", "rowkey").groupBy("is_risk").count().collect()}
    assert under == {1: 20, 0: 20}
    parts = splits.nth_part(df, 3, "rowkey").groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == [66, 67, 67]


def test_auc_agrees_with_mllib(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(float(r.random() < 0.3), r.randrange(20) / 20) for _ in range(500)], "label double, score double")
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert metrics.roc_auc(df, "label", "score").first()["auc"] == pytest.approx(want)


def test_last_round_is_the_model(spark):
    r = random.Random(2)
    rows = [(i, *(x := [r.random() for _ in range(3)]), int(x[0] + 0.3 * x[1] > 0.7)) for i in range(300)]
    df = spark.createDataFrame(rows, "rowkey int, a double, b double, c double, is_risk int")
    matrix = models.model_matrix(df, ["a", "b", "c"])
    model = models.boosted_trees(rounds=4, depth=2).fit(matrix)
    per_round = {x["iteration"]: x["f_beta"] for x in models.scores_per_round(model, matrix).collect()}
    whole = models.scored(model, matrix).agg(metrics.f_beta(F.col("label"), F.col("score")).alias("f")).first()["f"]
    assert len(per_round) == 4 and per_round[4] == pytest.approx(whole)


def test_neighbours_with_many_copies_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    r = np.random.default_rng(1)
    vectors = [[0.5, 0.5, 0.5]] * 60 + [list(map(float, v)) for v in r.random((120, 3))]
    base = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "key long, vector array<double>")
    got = neighbours.nearest_neighbours(base, base, 4).collect()
    m = np.array(vectors)
    for q in range(len(vectors)):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(len(m)), d))[:4]]
        assert [x["neighbour"] for x in sorted((x for x in got if x["query"] == q), key=lambda x: x["nth"])] == want


def test_store_keeps_rows_apart_by_key(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "rowkey int, a double")
    b = spark.createDataFrame([(2, 20.0, 0.0), (1, 10.0, 0.0)], "rowkey int, b double, unused double")
    files.write_features(a, str(tmp_path), "a")
    files.write_features(b, str(tmp_path), "b")
    joined = files.assemble(spark, str(tmp_path), {"a": ["a"], "b": ["b"]})
    assert sorted(map(tuple, joined.collect())) == [(1, 1.0, 10.0), (2, 2.0, 20.0)]
    assert "unused" not in joined._jdf.queryExecution().executedPlan().toString()


def test_hour_cycle_keeps_its_bound(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    got = {r["h"]: r["c"] for r in df.select("h", scalars.hour_cycle(F.col("h")).alias("c")).collect()}
    assert (got[0], got[10], got[11], got[12], got[23]) == (12, 22, -1, 0, 11)


def test_composite_keys_match_on_missing_parts(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("a", "x")], "a string, b string")
    assert df.select(scalars.composite_key(F.col("a"), F.col("b")).alias("k")).distinct().count() == 2


def test_csv_columns_are_found_by_name(spark, tmp_path):
    def written(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good = written("a.csv", "id,rowkey,is_risk,more,time\nU1,R1,1,x,2015-01-01 00:00:00\nU2,R2,,y,\n")
    rows = files.read_csv(spark, good, files.TRADE_SCHEMA).orderBy("rowkey").collect()
    assert rows[0].asDict() == {"rowkey": "R1", "id": "U1", "time": "2015-01-01 00:00:00", "is_risk": 1} and rows[1].is_risk is None
    with pytest.raises(ValueError, match="is_risk"):
        files.read_csv(spark, written("b.csv", "id,rowkey,time\nU,R,t\n"), files.TRADE_SCHEMA)
    bad = written("c.csv", "rowkey,id,time,is_risk\nR1,U1,t,many\nR2,U2,t,0\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, bad, files.TRADE_SCHEMA).collect()
    assert [r.is_risk for r in files.read_csv(spark, bad, files.TRADE_SCHEMA, "null").orderBy("rowkey").collect()] == [None, 0]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"price": 2.5, "listing_id": 1}\n{"listing_id": "no number"}\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_json(spark, str(tmp_path / "a.json"), files.LISTING_SCHEMA).collect()
    rows = files.read_json(spark, str(tmp_path / "a.json"), files.LISTING_SCHEMA, "null").collect()
    assert sorted((r.listing_id or 0, r.price or 0) for r in rows) == [(0, 0), (1, 2.5)]


def test_chi_square_tail():
    for degrees in range(2, 12):
        for x in (0.1, 1.0, 7.5, 30.0):
            grid = np.linspace(0, x, 200_001)[1:] - x / 400_000
            density = grid ** (degrees / 2 - 1) * np.exp(-grid / 2) / (2 ** (degrees / 2) * math.gamma(degrees / 2))
            assert featurestats.chi_square_tail(x, degrees) == pytest.approx(1 - density.sum() * x / 200_000, abs=2e-3)
    assert featurestats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert featurestats.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_columns_without_values_have_no_outliers(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, x double")
    assert {r.x_3sigma for r in featurestats.three_sigma(df, ["x"]).collect()} == {0}
    assert {r.x_tukey for r in featurestats.tukey(df, ["x"]).collect()} == {0}


def test_one_hot_limit_is_a_parameter(spark):
    df = spark.range(30).withColumnRenamed("id", "x")
    with pytest.raises(ValueError):
        featurestats.one_hot(df, "x", most=20)
    assert len(featurestats.one_hot(df, "x", most=30).columns) == 31


def test_folds_of_one_class_have_no_auc(spark):
    rows = [(i, float(i % 2) if i < 40 else 1.0, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "rowkey long, is_risk double, x double")
    folds = spark.createDataFrame(
        [(f, r, i) for f, held in ((0, range(30, 40)), (1, range(50, 60))) for i in range(60) for r in (["validation"] if i in held else ["train"] if i < 30 else [])],
        "fold int, role string, rowkey long",
    )
    found, fitted = models.mean_metrics(models.model_matrix(df, ["x"]), folds, [0, 1], models.decision_tree(2).fit)
    assert found["auc_folds"] == 1 and found["auc"] is not None and len(fitted) == 2
