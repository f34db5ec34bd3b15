"""Fitting and scoring with MLlib on an assembled feature table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.functions.scalars import MISSING
from priorsight.operators import metrics
from priorsight.operators.neighbours import nearest_neighbours
from priorsight.operators.splits import class_weights, shuffled_folds
from priorsight.plans.concurrent import AT_ONCE, together
from priorsight.plans.lineage import checkpoint_dir, cut, remove, shuffles_removed

Fit = Callable[[DataFrame], object]
#: Training and validation rows of a fold by its number.
Parts = Callable[[int], tuple[DataFrame, DataFrame]]


def model_matrix(df: DataFrame, features: Sequence[str], key: str = "rowkey", label: str = "is_risk") -> DataFrame:
    """Key, label and feature vector; missing features get the marker here and nowhere earlier."""
    filled = df.select(key, F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]).fillna(
        MISSING, list(features)
    )
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled).select(key, "label", "features")


def boosted_trees(
    rounds: int = 20, rate: float = 0.1, depth: int = 4, rows: float = 0.75, columns: float = 0.75, seed: int = 0, weight: str | None = None,
    validation: str | None = None, tolerance: float = 0.01,
) -> GBTClassifier:
    """``validation`` names a boolean column; boosting stops when the error of its rows falls by less than ``tolerance``."""
    extra = {"weightCol": weight} if weight else {}
    if validation:
        extra |= {"validationIndicatorCol": validation, "validationTol": tolerance}
    return GBTClassifier(
        maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=rows, featureSubsetStrategy=str(columns), seed=seed,
        featuresCol="features", labelCol="label", **extra,
    )


def random_forest(trees: int = 20, depth: int = 5, seed: int = 0, weight: str | None = None) -> RandomForestClassifier:
    extra = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", **extra)


def decision_tree(depth: int = 4, seed: int = 0) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")


def regression_tree(depth: int = 4, seed: int = 0) -> DecisionTreeRegressor:
    """A tree that splits by variance, which of a 0/1 label is half the Gini impurity; unlike a classifier it keeps splits whose sides agree."""
    return DecisionTreeRegressor(maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")


def logistic_regression(weight: str | None = None) -> LogisticRegression:
    extra = {"weightCol": weight} if weight else {}
    return LogisticRegression(maxIter=20, regParam=0.01, featuresCol="features", labelCol="label", **extra)


def linear_regression(penalty: float = 0.01) -> LinearRegression:
    return LinearRegression(maxIter=20, regParam=penalty, featuresCol="features", labelCol="label")


class NeighbourShare:
    """The share of label 1 among the ``k`` nearest training rows, features scaled to the training rows' deviations.

    Fitted and scored like the other estimators; keys are whole numbers.
    """

    def __init__(self, k: int, key: str = "rowkey"):
        self.k, self.key = k, key

    def fit(self, train: DataFrame) -> NeighbourShare:
        fitted = NeighbourShare(self.k, self.key)
        fitted.scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(train)
        fitted.base = fitted._vectors(train)
        return fitted

    def _vectors(self, matrix: DataFrame) -> DataFrame:
        return self.scaler.transform(matrix).select(F.col(self.key).cast("long").alias("key"), vector_to_array("scaled").alias("vector"), "label")

    def scores(self, matrix: DataFrame, name: str) -> DataFrame:
        return self.shares(matrix, {name: self.k})

    def shares(self, matrix: DataFrame, ks: Mapping[str, int]) -> DataFrame:
        """A column for each number of neighbours in ``ks``, from one search."""
        found = nearest_neighbours(self.base.drop("label"), self._vectors(matrix).drop("label"), max(ks.values()))
        labelled = found.join(self.base.select(F.col("key").alias("neighbour"), "label"), "neighbour")
        shares = labelled.groupBy("query").agg(*[F.avg(F.when(F.col("nth") <= k, F.col("label"))).alias(name) for name, k in ks.items()])
        return matrix.select(self.key, "label").join(shares, F.col(self.key) == F.col("query"), "left").select(self.key, "label", *ks)


def scored(model, matrix: DataFrame, name: str = "score", key: str = "rowkey") -> DataFrame:
    """Key, label and the probability of label 1 (or the prediction of a regression, or the share of neighbours)."""
    if isinstance(model, NeighbourShare):
        return model.scores(matrix, name)
    out = model.transform(matrix)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(key, "label", score.alias(name))


def margins_per_round(model: GBTClassificationModel, matrix: DataFrame) -> DataFrame:
    """``label``, ``iteration`` and ``margin``, the model's output when it is cut off after each boosting round.

    A row's tree outputs become an array of running sums, so the plan grows with the number of trees and not with its square.
    """
    out = matrix
    for i, tree in enumerate(model.trees):
        out = tree.setPredictionCol(f"tree_{i}").setFeaturesCol("features").transform(out)
    outputs = F.array(*[F.col(f"tree_{i}") * float(w) for i, w in enumerate(model.treeWeights)])
    sums = F.aggregate(outputs, F.array().cast("array<double>"), lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + x))
    return out.select("label", F.posexplode(sums).alias("at", "margin")).select("label", (F.col("at") + 1).alias("iteration"), "margin")


def _measured(rows: DataFrame, by: Sequence[str], score: str, threshold: float) -> DataFrame:
    """``f_beta`` and ``auc`` of every group: one aggregation and one order for all groups."""
    f_betas = rows.groupBy(*by).agg(metrics.f_beta(F.col("label"), F.col(score), threshold).alias("f_beta"))
    return f_betas.join(metrics.roc_auc_by(rows, "label", score, by).select(*by, "auc"), list(by), "left")


def scores_per_round(model: GBTClassificationModel, matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``iteration``, ``f_beta`` and ``auc`` of the model cut off after every boosting round."""
    probability = (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score")
    return _measured(margins_per_round(model, matrix).select("iteration", "label", probability), ["iteration"], "score", threshold)


def fold_parts(matrix: DataFrame, folds: DataFrame, fold: int, key: str = "rowkey") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one temporal fold."""
    chosen = folds.filter(F.col("fold") == fold)
    train = matrix.join(chosen.filter("role = 'train'").select(key), key, "left_semi")
    validation = matrix.join(chosen.filter("role = 'validation'").select(key), key, "left_semi")
    return train, validation


@contextmanager
def dealt(df: DataFrame, folds: DataFrame, numbers: Iterable[int], key: str = "rowkey") -> Iterator[Parts]:
    """While inside, the ``fold_parts`` of ``df`` for all ``numbers``, from rows that are matched with the folds and written once.

    Every fold and role has a folder of its own, so a fit reads its rows, and of these the columns that it asks for, and exchanges none.
    What is read from them must be written before the end, when they are deleted.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/folds-{uuid.uuid4().hex}"
    chosen = folds.filter(F.col("fold").isin(list(numbers))).select(key, F.col("fold").alias("in_fold"), F.col("role").alias("in_role")).distinct()
    rows = df.join(chosen, key).sortWithinPartitions("in_fold", "in_role", key)
    try:
        with shuffles_removed(spark):
            rows.write.partitionBy("in_fold", "in_role").parquet(path)
        table = spark.read.schema(rows.schema).parquet(path)
        part = lambda number, role: table.filter((F.col("in_fold") == number) & (F.col("in_role") == role)).select(*df.columns)
        yield lambda number: (part(number, "train"), part(number, "validation"))
    finally:
        remove(spark, path)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def per_round_over_folds(
    matrix: DataFrame, folds: DataFrame, numbers: Iterable[int], estimator: GBTClassifier, threshold: float = 0.5, at_once: int = AT_ONCE
) -> tuple[DataFrame, list]:
    """``f_beta`` and ``auc`` per fold and boosting round, and the fitted models.

    Folds are fitted side by side; the margins of all folds and rounds are then measured together.
    """
    numbers = list(numbers)

    def job(parts: Parts, number: int):
        train, validation = parts(number)
        model = estimator.fit(train)
        return model, cut(margins_per_round(model, validation).withColumn("fold", F.lit(number)))

    with dealt(matrix, folds, numbers) as parts:
        done = list(together(matrix.sparkSession, {f"fold {n}": lambda n=n: job(parts, n) for n in numbers}, at_once).values())
    probability = (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score")
    rows = _union(m for _, m in done).select("fold", "iteration", "label", probability)
    return _measured(rows, ["fold", "iteration"], "score", threshold), [model for model, _ in done]


def best_round(per_round: DataFrame, metric: str = "f_beta") -> DataFrame:
    """The round with the best metric on average over the folds, the earliest in a tie; both metrics' means."""
    mean = per_round.groupBy("iteration").agg(F.avg("f_beta").alias("f_beta"), F.avg("auc").alias("auc"))
    return mean.orderBy(F.desc(metric), "iteration").limit(1)


def importances(spark: SparkSession, models: Sequence, features: Sequence[str]) -> DataFrame:
    """Feature importance summed over models, most important first by ``place``."""
    totals = [0.0] * len(features)
    for model in models:
        for i, v in enumerate(model.featureImportances.toArray()):
            totals[i] += float(v)
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    rows = spark.createDataFrame(list(zip(features, totals)), schema)
    # One row per feature: a bound set by the model, not by the data.
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def important(ranked: DataFrame, share: float = 0.75, at_least: float | None = None) -> DataFrame:
    """The first ``share`` of the features by place, or those whose importance is ``at_least`` so high."""
    if at_least is not None:
        return ranked.filter(F.col("importance") >= at_least)
    return ranked.filter(F.col("place") <= F.lit(share) * ranked.count())


def tree_rules(model, features: Sequence[str]) -> DataFrame:
    """Every leaf of a fitted tree: ``leaf``, the conditions that lead to it, and what it predicts."""
    path: dict[int, str] = {}
    rows = []
    for line in model.toDebugString.splitlines():
        depth, text = len(line) - len(line.lstrip()), line.strip()
        if text.startswith("Predict:"):
            rows.append((len(rows), " and ".join(path[d] for d in sorted(path) if d < depth), float(text.removeprefix("Predict:"))))
        elif "(feature " in text:
            number, condition = text[text.index("(feature ") + 9 : -1].split(" ", 1)
            path = {d: c for d, c in path.items() if d < depth} | {depth: f"{features[int(number)]} {condition}"}
    return SparkSession.active().createDataFrame(rows, "leaf int, rule string, prediction double")


def tree_nodes(spark: SparkSession, models: Mapping[str, object], features: Sequence[str]) -> DataFrame:
    """The nodes of fitted trees and ensembles as rows: ``model, tree, node, depth, feature, threshold, gain, n_rows, prediction``.

    Read from the models' own node tables, so any number of trees is one scan; leaves have no feature, threshold or gain.
    """
    names = F.array(*[F.lit(f) for f in features])
    tables = []
    for name, model in models.items():
        path = f"{checkpoint_dir(spark)}/tables/model-{uuid.uuid4().hex[:12]}"
        model.write().save(path)
        data = spark.read.parquet(f"{path}/data")
        tree, node = ("treeID", "nodeData.") if "treeID" in data.columns else (F.lit(0), "")
        at = F.col(f"{node}split.featureIndex")
        tables.append(data.select(
            F.lit(name).alias("model"), (F.col(tree) if isinstance(tree, str) else tree).cast("int").alias("tree"), F.col(f"{node}id").alias("node"),
            F.when(at >= 0, F.get(names, at)).alias("feature"), F.when(at >= 0, F.get(f"{node}split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
            F.when(at >= 0, F.col(f"{node}gain")).alias("gain"), F.col(f"{node}rawCount").alias("n_rows"), F.col(f"{node}prediction").alias("prediction"),
            F.col(f"{node}leftChild").alias("left"), F.col(f"{node}rightChild").alias("right"),
        ))
    rows = cut(_union(tables))
    level = rows.filter("node = 0").withColumn("depth", F.lit(0))
    found = [level]
    while not level.filter("feature is not null").isEmpty():  # once a level, of which MLlib allows thirty
        below = level.filter("feature is not null").select("model", "tree", F.explode(F.array("left", "right")).alias("node"), (F.col("depth") + 1).alias("depth"))
        level = cut(rows.join(below, ["model", "tree", "node"]))
        found.append(level)
    return _union(found).select("model", "tree", "node", "depth", "feature", "threshold", "gain", "n_rows", "prediction")


def split_counts(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often each feature splits a node and what it gains in all; features that never split have zeros."""
    spark = nodes.sparkSession
    every = spark.createDataFrame([(f,) for f in features], "feature string")
    used = nodes.filter("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    return every.join(used, "feature", "left").fillna({"splits": 0, "gain": 0.0})


def fold_metrics(
    spark: SparkSession, jobs: Mapping[str, tuple[Parts, Fit]], numbers: Sequence[int], at_once: int = AT_ONCE, threshold: float = 0.5
) -> tuple[DataFrame, dict[str, list]]:
    """``name, fold, f_beta, auc`` of every job (the rows of the folds, as ``dealt`` gives them, and how to fit them) on every fold, and each job's models.

    All fits run side by side, ``at_once`` at a time, and all scores are measured together.  A fold whose validation rows are all of
    one class has no ``auc``; one without any validation rows has no row.
    """
    def job(name: str, number: int):
        parts, fit = jobs[name]
        train, validation = parts(number)
        model = fit(train)
        return model, cut(scored(model, validation).select("label", "score", F.lit(name).alias("name"), F.lit(number).alias("fold")))

    todo = {f"{name}, fold {n}": lambda name=name, n=n: job(name, n) for name in jobs for n in numbers}
    done = list(together(spark, todo, at_once).values())
    per = len(numbers)
    models = {name: [m for m, _ in done[i * per : (i + 1) * per]] for i, name in enumerate(jobs)}
    return _measured(_union(d for _, d in done), ["name", "fold"], "score", threshold), models


def means_of(per_fold: DataFrame) -> DataFrame:
    """Per name the mean ``f_beta`` and ``auc`` over the folds, and how many folds have an ``auc``."""
    return per_fold.groupBy("name").agg(F.avg("f_beta").alias("f_beta"), F.avg("auc").alias("auc"), F.count("auc").cast("int").alias("auc_folds"))


def mean_metrics(matrix: DataFrame, folds: DataFrame, numbers: Sequence[int], fit: Fit, at_once: int = AT_ONCE) -> tuple[dict, list]:
    """Mean ``f_beta`` and ``auc`` over the folds, how many folds the ``auc`` has, and the models."""
    with dealt(matrix, folds, numbers) as parts:
        return _means_and_models(matrix.sparkSession, parts, numbers, fit, at_once)


def _means_and_models(spark: SparkSession, parts: Parts, numbers: Sequence[int], fit: Fit, at_once: int) -> tuple[dict, list]:
    per_fold, models = fold_metrics(spark, {"all": (parts, fit)}, numbers, at_once)
    return means_of(per_fold).drop("name").first().asDict(), models["all"]


def _matrices(parts: Parts, features: Sequence[str]) -> Parts:
    """The rows of the folds with the ``features`` as a vector."""
    return lambda number: tuple(model_matrix(part, features) for part in parts(number))


_METRICS = "f_beta double, auc double, auc_folds int"


def backward_elimination(
    df: DataFrame, features: Sequence[str], folds: DataFrame, numbers: Sequence[int], fit: Fit, keep: float = 0.95, until: float = 0.2, at_once: int = AT_ONCE
) -> DataFrame:
    """Keep the most important ``keep`` of what is left, while more than ``until`` of all are; one row per step with its mean metrics.

    Steps follow each other, as each needs the last one's importances; the folds of a step are fitted side by side.
    """
    left, steps = list(features), []
    with dealt(df.select("rowkey", "is_risk", *features), folds, numbers) as parts:
        while left:
            found, models = _means_and_models(df.sparkSession, _matrices(parts, left), numbers, fit, at_once)
            ranked = [r["feature"] for r in importances(df.sparkSession, models, left).orderBy("place").select("feature").collect()]
            steps.append((len(steps), len(left), *found.values(), ranked))
            if len(left) <= until * len(features):
                break
            left = ranked[: int(keep * len(left))]
    return df.sparkSession.createDataFrame(steps, f"step int, n_features int, {_METRICS}, features array<string>")


def grid_search(
    matrix: DataFrame, folds: DataFrame, numbers: Sequence[int], grid: Sequence[Mapping], estimator: Callable[..., object], at_once: int = AT_ONCE
) -> DataFrame:
    """Mean F-beta and AUC over the temporal folds for every setting of the grid; all fits side by side."""
    with dealt(matrix, folds, numbers) as parts:
        jobs = {str(dict(s)): (parts, estimator(**s).fit) for s in grid}
        per_fold, _ = fold_metrics(matrix.sparkSession, jobs, numbers, at_once)
    return means_of(per_fold).withColumnRenamed("name", "setting")


def ablation(df: DataFrame, sets: Mapping[str, Sequence[str]], folds: DataFrame, numbers: Sequence[int], fit: Fit, at_once: int = AT_ONCE) -> DataFrame:
    """Mean metrics over the folds for every named set of features; all fits side by side."""
    spark = df.sparkSession
    used = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    with dealt(df.select("rowkey", "is_risk", *used), folds, numbers) as parts:
        per_fold, _ = fold_metrics(spark, {name: (_matrices(parts, columns), fit) for name, columns in sets.items()}, numbers, at_once)
    sizes = spark.createDataFrame([(name, len(columns)) for name, columns in sets.items()], "name string, n_features int")
    return means_of(per_fold).join(F.broadcast(sizes), "name")


def _fitted_together(estimators: Mapping[str, object]) -> list[tuple[str, ...]]:
    """Names of estimators by fit: neighbour shares that differ in how many neighbours they ask take one search, all others one fit each."""
    groups: dict[object, list[str]] = {}
    for name, estimator in estimators.items():
        groups.setdefault(("neighbours", estimator.key) if isinstance(estimator, NeighbourShare) else name, []).append(name)
    return [tuple(names) for names in groups.values()]


def _scored_by(estimators: Mapping[str, object], train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``key, learner, score`` of the test rows, written; several estimators are neighbour shares."""
    first, *others = estimators.values()
    model = first.fit(train)
    if not others:
        return cut(scored(model, test, "score", key).select(key, F.lit(next(iter(estimators))).alias("learner"), "score"))
    shares = model.shares(test, {name: e.k for name, e in estimators.items()})
    return cut(shares.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("learner"), F.col(name).alias("score")) for name in estimators])).alias("s")).select(key, "s.*"))


def out_of_fold(
    matrix: DataFrame, estimators: Mapping[str, object], fold: str = "fold", k: int = 5, key: str = "rowkey", at_once: int = AT_ONCE
) -> DataFrame:
    """A meta feature per estimator: each row scored by the model fitted on the other folds.  Key, label, ``fold`` and the scores."""
    def job(names: tuple[str, ...], number: int) -> DataFrame:
        rest, own = matrix.filter(F.col(fold) != number), matrix.filter(F.col(fold) == number)
        return _scored_by({name: estimators[name] for name in names}, rest, own, key)

    todo = {f"{', '.join(names)}, fold {n}": lambda names=names, n=n: job(names, n) for names in _fitted_together(estimators) for n in range(k)}
    return matrix.select(key, "label", fold).join(_wide(together(matrix.sparkSession, todo, at_once).values(), list(estimators), key), key)


def meta_features(train: DataFrame, test: DataFrame, estimators: Mapping[str, object], key: str = "rowkey", at_once: int = AT_ONCE) -> DataFrame:
    """The test side of stacking: scores of models fitted on all training rows."""
    def job(names: tuple[str, ...]) -> DataFrame:
        return _scored_by({name: estimators[name] for name in names}, train, test, key)

    todo = {", ".join(names): lambda names=names: job(names) for names in _fitted_together(estimators)}
    return test.select(key, "label").join(_wide(together(train.sparkSession, todo, at_once).values(), list(estimators), key), key)


def _wide(parts: Iterable[DataFrame], learners: Sequence[str], key: str) -> DataFrame:
    """One row a key with a column of scores for each learner, by one aggregation instead of a join a learner."""
    return _union(parts).groupBy(key).agg(*[F.max(F.when(F.col("learner") == n, F.col("score"))).alias(n) for n in learners])


def stack(
    train: DataFrame, test: DataFrame, estimators: Mapping[str, object], meta, thresholds: Sequence[float], k: int = 5, meta_folds: int = 5, key: str = "rowkey",
    at_once: int = AT_ONCE,
) -> tuple[DataFrame, DataFrame]:
    """Test rows scored by a model of models, and the sweep that chose its threshold.

    ``train`` has a ``fold`` column of ``k`` folds, out of which every learner scores it.  The meta model is judged on shuffled folds of
    its own, drawn anew; the threshold with the best F-beta there (the least in a tie) labels the test rows, which the meta model
    fitted on all out-of-fold scores has scored.  First result: key, label, ``score``, ``is_risk``.
    """
    learners = list(estimators)
    inside = cut(out_of_fold(train, estimators, k=k, key=key, at_once=at_once))
    outside = cut(meta_features(train.drop("fold"), test, estimators, key, at_once))
    as_matrix = lambda df: model_matrix(df.withColumnRenamed("label", "is_risk"), learners, key)
    again = shuffled_folds(inside.select(key), key, meta_folds, salt="meta").select(key, "fold")
    judged = cut(out_of_fold(cut(as_matrix(inside).join(again, key)), {"score": meta}, k=meta_folds, key=key, at_once=at_once))
    sweep = cut(metrics.threshold_sweep(judged, "label", "score", thresholds))
    best = sweep.orderBy(F.desc("f_beta"), "threshold").first()["threshold"]
    final = scored(meta.fit(as_matrix(inside)), as_matrix(outside), key=key)
    return final.withColumn("is_risk", (F.col("score") > best).cast("int")), sweep


def weighted(matrix: DataFrame, positive: float | None = None) -> DataFrame:
    return class_weights(matrix, "label", positive)
