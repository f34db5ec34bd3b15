"""Models on a feature table built from the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import DAYS, HABIT_DAYS, LOGS, logins, rounded, table, trades
from priorsight.catalog.splitting import _FOLDS, _WEEK, _folds_sql, week
from priorsight.operators import families, models, splits
from priorsight.operators.hashed_neighbours import hashed_neighbours, recall
from priorsight.operators.neighbours import nearest_neighbours, neighbour_vote, vote
from priorsight.plans.concurrent import together
from priorsight.plans.lineage import cut
from priorsight.sources import files

_BUCKETS = 16
_STORES: dict[tuple[str, str], tuple[str, dict[str, list[str]]]] = {}


def store(spark, sf):
    """The stored families of these tables and the columns of each; written once a session, as all models read them."""
    where = (spark.sparkContext.applicationId, sf)
    if where not in _STORES:
        folder, log, asked = files.scratch_path(spark, "families"), logins(spark, sf), trades(spark, sf)
        statistics = families.login_trade_statistics(log, asked, DAYS)
        failures = families.repeated_failure_flags(log, asked, DAYS)
        habits = families.habit_features(log, asked, HABIT_DAYS)
        calendar = asked.select("rowkey", "time", "is_risk", F.hour("time").alias("hour"), F.weekday("time").alias("weekday"), "period")
        sets = {}
        for name, family in (("trades", calendar), ("statistics", statistics), ("failures", failures), ("habits", habits)):
            kept = [c for c in family.columns if c not in ("rowkey", "id", "us", "time", "is_risk")]
            files.write_bucketed(family.select("rowkey", *[c for c in family.columns if c in ("time", "is_risk")], *kept), folder, name, buckets=_BUCKETS)
            sets[name] = kept
        _STORES[where] = (folder, sets)
    return _STORES[where]


def feature_table(spark, sf, chosen=("trades", "statistics", "failures", "habits")):
    """Trades with the chosen families beside them, joined bucket by bucket, and the names of all features."""
    folder, sets = store(spark, sf)
    columns = {"trades": ["time", "is_risk", *sets["trades"]]} | {name: sets[name] for name in chosen if name != "trades"}
    return files.assemble_bucketed(spark, folder, columns, buckets=_BUCKETS), [c for name in chosen for c in sets[name]]


def _setup(spark, sf, chosen=("trades", "statistics", "failures", "habits")):
    features, names = feature_table(spark, sf, chosen)
    folds = cut(splits.temporal_folds(features, week(), _FOLDS, "rowkey"))
    return features, names, cut(models.model_matrix(features, names)), folds


def _boost(**settings):
    """Settings of the kind that the feature sets are judged with; a fit of a long log takes more rounds at a lower rate."""
    return models.boosted_trees(**{"rounds": 10, "depth": 4, "rate": 0.1, "rows": 0.75, "columns": 0.25, **settings})


def _periods(features):
    """Rows up to the twentieth of the month, to fit on, and later ones, to score."""
    early = F.dayofmonth("time") <= 20
    return features.filter(early), features.filter(~early)


def _scores(spark, sf, estimator, weight=None, positive=None):
    features, names = feature_table(spark, sf)
    early, late = (models.model_matrix(part, names) for part in _periods(features))
    if weight:
        early = models.weighted(early, positive)
    return rounded(models.scored(estimator.fit(cut(early)), late))


@query("M1_boosted_trees")
def boosted_trees(spark, sf):
    return _scores(spark, sf, _boost(weight="weight"), "weight", 10)


@query("M1_early_stopping")
def early_stopping(spark, sf):
    features, names = feature_table(spark, sf)
    early, late = _periods(features)
    matrix = models.model_matrix(early, names).join(early.select("rowkey", (F.dayofmonth("time") > 15).alias("held")), "rowkey")
    stopped = _boost(rounds=30, rate=0.3, validation="held").fit(cut(matrix))
    return rounded(models.scored(stopped, models.model_matrix(late, names)))


@query("M2_best_iteration")
def best_iteration(spark, sf):
    _, _, matrix, folds = _setup(spark, sf)
    per_round, _ = models.per_round_over_folds(matrix, folds, range(6), _boost(rate=0.3))
    return rounded(models.best_round(per_round, "auc"))


@query("M2_metric_per_iteration")
def metric_per_iteration(spark, sf):
    _, _, matrix, folds = _setup(spark, sf)
    return rounded(models.per_round_over_folds(matrix, folds, range(6), _boost(rate=0.3))[0])


@query("M3_random_forest")
def random_forest(spark, sf):
    return _scores(spark, sf, models.random_forest(20, 5, weight="weight"), "weight")


#: Whole numbers of few values, on which every split between two values is tried.
_PLAIN = ("hour", "weekday", "period")


def _splits_sql(rows: str) -> str:
    """Every split of ``rows`` (part, label, the plain features) by how much variance it takes away, best first."""
    values = " union all ".join(f"select part, label, '{c}' as feature, {c} as v from rows" for c in _PLAIN)
    return (
        f"rows as ({rows}), x as ({values}), per as (select part, feature, v, sum(label) as yes, count(*) as n from x group by all), "
        "run as (select *, sum(yes) over w as ly, sum(n) over w as ln, sum(yes) over p as y, sum(n) over p as c, lead(v) over (partition by part, feature order by v) as nextv "
        "from per window w as (partition by part, feature order by v), p as (partition by part, feature)), "
        "gains as (select part, feature, (v + nextv) / 2 as threshold, (y / c) * (1 - y / c) - ln / c * (ly / ln) * (1 - ly / ln) "
        "- (c - ln) / c * ((y - ly) / (c - ln)) * (1 - (y - ly) / (c - ln)) as gain from run where nextv is not null), "
        "best as (select *, row_number() over (partition by part order by gain desc, feature, threshold) as place from gains)"
    )


_EARLY = "select 0 as part, is_risk as label, hour(time) as hour, isodow(time) - 1 as weekday, period from t where day(time) <= 20"


def _plain_matrix(spark, sf):
    """Early rows with the plain features only."""
    asked = trades(spark, sf).select("rowkey", "time", "is_risk", F.hour("time").alias("hour"), F.weekday("time").alias("weekday"), "period")
    return asked, models.model_matrix(asked, _PLAIN)


@query("M4_best_split", f"with {LOGS}, {_splits_sql(_EARLY)} select feature, round(threshold, 6) as threshold, round(gain, 6) as gain from best where place = 1")
def best_split(spark, sf):
    asked, _ = _plain_matrix(spark, sf)
    fitted = models.regression_tree(1).fit(models.model_matrix(asked.filter(F.dayofmonth("time") <= 20), _PLAIN))
    nodes = models.tree_nodes(spark, {"tree": fitted}, _PLAIN)
    return rounded(nodes.filter("depth = 0").select("feature", "threshold", "gain"))


_FOLD_ROWS = "select fold as part, is_risk as label, hour(time) as hour, isodow(time) - 1 as weekday, period from t join f using (rowkey) where role = 'train'"


@query(
    "M7_split_counts",
    f"with {LOGS}, p as (select rowkey, {_WEEK} as w from t), f as ({_folds_sql().split('from t) ', 1)[1]}), {_splits_sql(_FOLD_ROWS)} "
    "select a.feature, count(b.feature) as splits, round(coalesce(sum(b.gain), 0), 6) as gain from (values ('hour'), ('weekday'), ('period')) a(feature) "
    "left join best b on b.feature = a.feature and b.place = 1 group by a.feature",
)
def split_counts(spark, sf):
    """Which feature splits the training rows of each fold best, counted over the folds."""
    asked, matrix = _plain_matrix(spark, sf)
    folds, matrix = cut(splits.temporal_folds(asked, week(), _FOLDS, "rowkey")), cut(matrix)
    fits = {f"fold {n}": lambda n=n: models.regression_tree(1).fit(models.fold_parts(matrix, folds, n)[0]) for n in range(6)}
    return rounded(models.split_counts(models.tree_nodes(spark, together(spark, fits), _PLAIN), _PLAIN))


@query("M7_split_counts_of_boosting")
def split_counts_of_boosting(spark, sf):
    features, names = feature_table(spark, sf)
    fitted = _boost().fit(cut(models.model_matrix(_periods(features)[0], names)))
    return rounded(models.split_counts(models.tree_nodes(spark, {"boosted": fitted}, names), names))


@query("M4_decision_tree")
def decision_tree(spark, sf):
    return _scores(spark, sf, models.decision_tree(3))


@query("M4_tree_rules")
def tree_rules(spark, sf):
    features, names = feature_table(spark, sf)
    return rounded(models.tree_rules(models.decision_tree(3).fit(models.model_matrix(_periods(features)[0], names)), names))


@query("M5_logistic_regression")
def logistic_regression(spark, sf):
    return _scores(spark, sf, models.logistic_regression("weight"), "weight")


@query("M5_linear_regression")
def linear_regression(spark, sf):
    return _scores(spark, sf, models.linear_regression())


@query(
    "M5_least_squares",
    f"with {LOGS}, m as (select regr_slope(is_risk, hour(time)) as slope, regr_intercept(is_risk, hour(time)) as start from t where day(time) <= 20) "
    "select rowkey, cast(is_risk as double) as label, round(start + slope * hour(time), 6) as score from t, m where day(time) > 20",
)
def least_squares(spark, sf):
    """A line through one feature, without a penalty."""
    asked, _ = _plain_matrix(spark, sf)
    early, late = (models.model_matrix(part, ["hour"]) for part in _periods(asked))
    return rounded(models.scored(models.linear_regression(penalty=0.0).fit(early), late))


def _vote_sql(k: int) -> str:
    return (
        "with d as (select a.vec_id, b.vec_id as other, b.label, row_number() over (partition by a.vec_id order by "
        "list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) as nth from embeddings a join embeddings b on a.vec_id <> b.vec_id), "
        f"v as (select vec_id, label, count(*) as votes from d where nth <= {k} group by all), "
        "w as (select *, row_number() over (partition by vec_id order by votes desc, label) as place, sum(votes) over (partition by vec_id) as total from v) "
        "select vec_id as key, label, round(votes / total, 6) as share from w where place = 1"
    )


def _vote(k: int) -> None:
    @query(f"M6_neighbour_vote_{k}", _vote_sql(k))
    def vote(spark, sf):
        vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
        return rounded(neighbour_vote(vectors, vectors, vectors.select("key", "label"), k, same_table=True))


_vote(3)
_vote(5)


@query("M6_neighbour_vote_lsh", _vote_sql(5).replace("round(votes / total, 6) as share", "round(votes / total, 6) as share, true as recall_reached"))
def vote_lsh(spark, sf):
    """The vote among hashed neighbours; a row that misses one of its neighbours is given the exact vote, and the recall of all is held against 0.95."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    labels = vectors.select("key", "label")
    found = cut(hashed_neighbours(vectors, vectors, 6))
    exact = cut(nearest_neighbours(vectors, vectors, 6))
    shares = cut(recall(found, exact))
    total = shares.agg((F.sum("n_found") / F.sum("n_exact")).alias("recall")).first()["recall"]
    whole = shares.select(F.col("query").alias("key"), (F.col("n_found") == F.col("n_exact")).alias("whole"))
    hashed, known = (vote(x, labels, 5, same_table=True) for x in (found, exact))
    chosen = hashed.join(whole.filter("whole"), "key", "left_semi").union(known.join(whole.filter("not whole"), "key", "left_semi"))
    return rounded(chosen.withColumn("recall_reached", F.lit(total >= 0.95)))


@query("M7_feature_importance")
def feature_importance(spark, sf):
    _, names, matrix, folds = _setup(spark, sf)
    _, fitted = models.per_round_over_folds(matrix, folds, range(6), _boost())
    return rounded(models.importances(spark, fitted, names))


@query("M7_top_features")
def top_features(spark, sf):
    _, names, matrix, folds = _setup(spark, sf)
    _, fitted = models.per_round_over_folds(matrix, folds, range(6), _boost())
    return rounded(models.important(models.importances(spark, fitted, names)))


@query("M8_backward_elimination")
def backward_elimination(spark, sf):
    """Five percent of what is left goes in each step, down to a fifth of the features."""
    features, names, _, folds = _setup(spark, sf, ("trades", "failures", "statistics"))
    fit = models.random_forest(5, 4).fit
    return rounded(models.backward_elimination(features, names, folds, range(6), fit, keep=0.95, until=0.2, at_once=8))


@query("M9_grid_search")
def grid_search(spark, sf):
    _, _, matrix, folds = _setup(spark, sf)
    grid = [{"rounds": 5, "depth": d, "rate": r, "columns": c} for d in (3, 5) for r in (0.1, 0.3) for c in (0.25, 0.75)]
    return rounded(models.grid_search(matrix, folds, range(6), grid, _boost, at_once=8))


@query("M9_forest_grid_search")
def forest_grid_search(spark, sf):
    _, _, matrix, folds = _setup(spark, sf)
    grid = [{"trees": n, "depth": d} for n in (10, 20) for d in (3, 5, 7)]
    return rounded(models.grid_search(matrix, folds, range(6), grid, models.random_forest, at_once=8))


@query("M10_ablation")
def ablation(spark, sf):
    """The booster on sets that grow family by family."""
    features, _, _, folds = _setup(spark, sf)
    _, known = store(spark, sf)
    sets, so_far = {}, []
    for family in ("trades", "statistics", "failures", "habits"):
        so_far = so_far + known[family]
        sets[f"with_{family}"] = so_far
    return rounded(models.ablation(features, sets, folds, range(6), _boost(rounds=5).fit, at_once=8))


_SWEPT = tuple(i / 20 for i in range(1, 20))


def _stacked(spark, sf):
    features, names = feature_table(spark, sf, ("trades", "statistics", "failures"))
    early, late = _periods(features)
    matrix = cut(models.model_matrix(early, names).join(splits.shuffled_folds(early.select("rowkey"), "rowkey", 5), "rowkey"))
    learners = {
        "boosted_deep": _boost(rounds=5, depth=6), "boosted_shallow": _boost(rounds=10, depth=3), "forest": models.random_forest(10, 6),
        "logistic": models.logistic_regression(), "linear": models.linear_regression(),
        "neighbours_3": models.NeighbourShare(3), "neighbours_5": models.NeighbourShare(5),
    }
    return models.stack(matrix, cut(models.model_matrix(late, names)), learners, models.logistic_regression(), _SWEPT, at_once=8)


@query("M16_stacking")
def stacking(spark, sf):
    """Seven learners under a meta model: the later period's scores and labels."""
    return rounded(_stacked(spark, sf)[0])
