"""Fits side by side, metrics of many groups at once, nodes of trees, stacking."""

import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from priorsight.operators import metrics, models, splits
from priorsight.plans.concurrent import JobFailed, together


def area(pairs):
    yes, no = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no)) if yes and no else None


def test_area_of_many_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randrange(3), rng.randrange(2), rng.randrange(8) / 8) for _ in range(3000)]
    rows += [("one", 0, 1, 0.5)] * 4 + [("none", 1, 0, 0.1)] + [("gap", 0, 1, None), ("gap", 0, 0, 0.3), ("gap", 0, 1, 0.2), ("gap", 0, None, 0.9)]
    df = spark.createDataFrame(rows, "g string, h int, label int, score double").repartition(7)
    got = {(r.g, r.h): (r.auc, r.yes, r.no) for r in metrics.roc_auc_by(df, "label", "score", ["g", "h"]).collect()}
    groups = {}
    for g, h, y, s in rows:
        if s is not None and y is not None:
            groups.setdefault((g, h), []).append((y, s))
    assert set(got) == set(groups)
    for k, pairs in groups.items():
        want = area(pairs)
        assert got[k][0] == (want if want is None else pytest.approx(want)) and got[k][1] == sum(y for y, _ in pairs)
    assert metrics.roc_auc_by(df.limit(0), "label", "score", ["g"]).count() == 0
    assert metrics.roc_auc(df, "label", "score").first()["auc"] == pytest.approx(area([p for v in groups.values() for p in v]))


def test_jobs_run_together_within_the_bound(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        n = spark.range(10 + i).count()
        with lock:
            running[0] -= 1
        return n

    for at_once in (1, 3):
        most[0], began = 0, time.time()
        got = together(spark, {f"j{i}": lambda i=i: job(i) for i in range(6)}, at_once)
        assert got == {f"j{i}": 10 + i for i in range(6)} and list(got) == [f"j{i}" for i in range(6)]
        assert most[0] == at_once
    assert together(spark, {}) == {}


def test_the_failing_job_is_named_and_others_are_given_up(spark):
    begun = []

    def job(i):
        begun.append(i)
        if i == 1:
            raise ValueError("no such column")
        time.sleep(0.2)

    with pytest.raises(JobFailed, match="j1 failed") as error:
        together(spark, {f"j{i}": lambda i=i: job(i) for i in range(30)}, 2)
    assert isinstance(error.value.__cause__, ValueError) and len(begun) < 30
    assert spark.range(5).count() == 5


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = []
    for i in range(360):
        a, b, c = rng.randrange(12), rng.randrange(5), rng.random()
        rows.append((i, i % 3, int(a + b + rng.random() * 4 > 9), float(a), float(b), None if i % 17 == 0 else c))
    return spark.createDataFrame(rows, "rowkey long, period int, is_risk int, a double, b double, c double").cache()


@pytest.fixture(scope="module")
def folds(table):
    return splits.temporal_folds(table, F.col("period"), [((0, 1), 2)], "rowkey").cache()


def test_metrics_of_folds_and_rounds(table, folds):
    matrix = models.model_matrix(table, ["a", "b", "c"])
    per_round, fitted = models.per_round_over_folds(matrix, folds, range(3), models.boosted_trees(rounds=3, depth=2))
    got = {(r.fold, r.iteration): r for r in per_round.collect()}
    assert set(got) == {(f, i) for f in range(3) for i in (1, 2, 3)}
    for fold, model in enumerate(fitted):
        _, validation = models.fold_parts(matrix, folds, fold)
        pairs = [(r.label, r.score) for r in models.scored(model, validation).collect()]
        assert got[fold, 3].auc == pytest.approx(area(pairs))
        alone = {r.iteration: (r.f_beta, r.auc) for r in models.scores_per_round(model, validation).collect()}
        assert {i: pytest.approx(alone[i][1]) for i in alone} == {i: got[fold, i].auc for i in alone}
    assert models.best_round(per_round, "auc").first()["iteration"] in (1, 2, 3)


def test_grid_and_ablation(table, folds):
    matrix = models.model_matrix(table, ["a", "b", "c"])
    grid = models.grid_search(matrix, folds, range(3), [{"depth": 1}, {"depth": 4}], models.decision_tree, at_once=3)
    got = {r.setting: r for r in grid.collect()}
    assert set(got) == {"{'depth': 1}", "{'depth': 4}"}
    one, _ = models.mean_metrics(matrix, folds, range(3), models.decision_tree(4).fit)
    assert got["{'depth': 4}"].auc == pytest.approx(one["auc"]) and one["auc_folds"] == 3
    sets = {"noise": ["c"], "all": ["a", "b", "c"]}
    ablated = {r.name: r for r in models.ablation(table, sets, folds, range(3), models.decision_tree(3).fit).collect()}
    assert ablated["all"].auc > ablated["noise"].auc and ablated["all"].n_features == 3


def test_nodes_of_trees(spark, table):
    features = ["a", "b", "c"]
    matrix = models.model_matrix(table, features)
    tree, boosted = models.decision_tree(3).fit(matrix), models.boosted_trees(rounds=3, depth=2, rows=1.0, columns=1.0).fit(matrix)
    nodes = models.tree_nodes(spark, {"tree": tree, "boosted": boosted}, features).cache()
    per = {(r["model"], r["tree"]): r["count"] for r in nodes.groupBy("model", "tree").count().collect()}
    assert per == {("tree", 0): tree.numNodes} | {("boosted", i): t.numNodes for i, t in enumerate(boosted.trees)}
    depths = {r["model"]: r["d"] for r in nodes.groupBy("model").agg(F.max("depth").alias("d")).collect()}
    assert depths == {"tree": tree.depth, "boosted": max(t.depth for t in boosted.trees)}
    leaves = nodes.filter("model = 'tree' and feature is null")
    assert leaves.count() == models.tree_rules(tree, features).count() and leaves.agg(F.sum("n_rows")).first()[0] == 360
    counted = {r.feature: r.splits for r in models.split_counts(nodes, [*features, "never"]).collect()}
    assert counted["never"] == 0 and sum(counted.values()) == nodes.filter("feature is not null").count()


def test_neighbour_share(spark, table):
    matrix = models.model_matrix(table, ["a", "b"])
    train, test = matrix.filter("rowkey % 4 <> 0"), matrix.filter("rowkey % 4 = 0")
    got = {r.rowkey: r.score for r in models.scored(models.NeighbourShare(5).fit(train), test).collect()}
    rows = [(r.rowkey, r.label, r.features.toArray()) for r in train.collect()]
    mean = [sum(f[j] for _, _, f in rows) / len(rows) for j in (0, 1)]
    dev = [math.sqrt(sum((f[j] - mean[j]) ** 2 for _, _, f in rows) / (len(rows) - 1)) for j in (0, 1)]
    for r in test.collect():
        near = sorted((round(math.dist([x / d for x, d in zip(f, dev)], [x / d for x, d in zip(r.features.toArray(), dev)]), 9), k, y) for k, y, f in rows)[:5]
        assert got[r.rowkey] == pytest.approx(sum(y for _, _, y in near) / 5)


def test_stack(table):
    matrix = models.model_matrix(table, ["a", "b", "c"])
    train = matrix.filter("rowkey < 260").join(splits.shuffled_folds(table.select("rowkey"), "rowkey", 3), "rowkey")
    test = matrix.filter("rowkey >= 260")
    learners = {"tree": models.decision_tree(3), "logistic": models.logistic_regression(), "near": models.NeighbourShare(3)}
    done, sweep = models.stack(train, test, learners, models.logistic_regression(), (0.2, 0.5, 0.8), k=3, meta_folds=3)
    rows, swept = done.collect(), {r.threshold: r for r in sweep.collect()}
    assert {r.rowkey for r in rows} == set(range(260, 360)) and set(swept) == {0.2, 0.5, 0.8}
    assert all(r.tp + r.fp + r.fn + r.tn == 260 for r in swept.values())
    best = min(swept, key=lambda t: (-swept[t].f_beta, t))
    assert all(r.is_risk == int(r.score > best) for r in rows)
    assert area([(r.label, r.score) for r in rows]) > 0.8


def test_rows_of_folds_are_written_once_and_read_without_an_exchange(spark, table, folds):
    odd = table.union(table.filter("rowkey < 5")).union(table.limit(3).withColumn("rowkey", F.lit(None).cast("long")))
    twice = folds.union(folds)
    seen = lambda df: sorted(map(tuple, df.select("rowkey", "a", "c").collect()), key=str)
    with models.dealt(odd, twice, range(3)) as parts:
        for fold in range(3):
            for got, want in zip(parts(fold), models.fold_parts(odd, twice, fold)):
                assert seen(got) == seen(want) and got.schema == odd.schema
                assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert parts(0)[0].count() and not parts(7)[0].count()
    with models.dealt(odd.limit(0), twice, range(3)) as parts:
        assert parts(1)[0].count() == 0


def test_every_search_over_folds_matches_rows_and_folds_once(table, folds, monkeypatch):
    def none(*args, **kwargs):
        raise AssertionError("a fit matched rows and folds for itself")

    monkeypatch.setattr(models, "fold_parts", none)
    matrix, fit = models.model_matrix(table, ["a", "b", "c"]), models.decision_tree(2).fit
    assert models.grid_search(matrix, folds, range(3), [{"depth": 1}, {"depth": 2}], models.decision_tree).count() == 2
    assert models.ablation(table, {"one": ["a"], "two": ["a", "b"]}, folds, range(3), fit).count() == 2
    steps = models.backward_elimination(table, ["a", "b", "c"], folds, range(3), fit, keep=0.7, until=0.4).orderBy("step").collect()
    assert [s.n_features for s in steps] == [3, 2, 1] and set(steps[1].features) < set(steps[0].features)
    per_round, _ = models.per_round_over_folds(matrix, folds, range(3), models.boosted_trees(rounds=2, depth=2))
    assert per_round.count() == 6


def test_shares_of_several_numbers_of_neighbours_take_one_search(table, monkeypatch):
    matrix = models.model_matrix(table, ["a", "b", "c"])
    train = matrix.join(splits.shuffled_folds(table.select("rowkey"), "rowkey", 2), "rowkey").cache()
    search, asked = models.nearest_neighbours, []
    monkeypatch.setattr(models, "nearest_neighbours", lambda base, queries, k: asked.append(k) or search(base, queries, k))
    both = {"three": models.NeighbourShare(3), "five": models.NeighbourShare(5)}
    got = {r.rowkey: (r.three, r.five) for r in models.out_of_fold(train, both, k=2).collect()}
    assert asked == [5, 5] and len(got) == 360
    for place, (name, learner) in enumerate(both.items()):
        alone = {r.rowkey: r[name] for r in models.out_of_fold(train, {name: learner}, k=2).collect()}
        assert alone == {k: v[place] for k, v in got.items()}
