"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest of shallow trees is fitted to the statistics of labelled documents.
Every path from a root to an inner node or leaf is a conjunctive rule; a lasso
logistic regression picks few of them and weighs them.  The picked rules become one Spark column
expression, so that scoring runs in the JVM without Python or model objects.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.plans.lineage import cut

#: Labelled documents fitted to, about, if there are more; drawn by hashing ids.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.0015
#: Documents scored at least so high are kept.
THRESHOLD = 0.7

#: Ratios and counts of a text that rules may speak of.
STATISTICS = (
    "log_words", "word_length", "letter_share", "upper_share", "digit_share", "space_share", "sentence_marks", "odd_marks", "bars", "exclamations",
    "distinct_words", "repeated_neighbours", "distinct_lines", "line_length", "words_ending_odd",
)


def statistics(text: Column) -> list[tuple[str, Column]]:
    """Steps of (name, expression): counts first, then what is made of them; empty or null texts give zeros."""
    count = lambda pattern: F.regexp_count("q_text", F.lit(pattern)).cast("double")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return [
        [("q_text", F.coalesce(text, F.lit("")))],
        [
            ("q_words", F.filter(F.split("q_text", r"\s+"), lambda w: w != "")),
            ("q_lines", F.filter(F.split("q_text", "\n"), lambda w: w != "")),
            ("q_chars", F.length("q_text").cast("double")),
            ("q_letters", count(r"\p{L}")), ("q_upper", count(r"\p{Lu}")), ("q_digits", count(r"\p{Nd}")), ("q_spaces", count(r"\s")),
            ("q_marks", count(r"[.,;:?]")), ("q_odd", count(r"[#$%&*@^~<>=+\\{}\[\]_]")), ("q_bars", count(r"\|")), ("q_shouts", count("!")),
            ("q_oddends", count(r"(?<![#$%&*@^~<>=+|!])[#$%&*@^~<>=+|!]{2,}+(?=\s|$)")), ("q_doubled", count(r"(?<!\S)(\S+)\s+\1(?!\S)")),
        ],
        [
            ("q_n", F.size("q_words").cast("double")), ("q_distinct", F.size(F.array_distinct("q_words")).cast("double")),
            ("q_nlines", F.size("q_lines").cast("double")), ("q_dlines", F.size(F.array_distinct("q_lines")).cast("double")),
        ],
        [
            ("log_words", F.log1p("q_n")), ("word_length", F.when(F.col("q_n") > 0, (F.col("q_chars") - F.col("q_spaces")) / F.col("q_n")).otherwise(0.0)),
            ("letter_share", share("q_letters", "q_chars")), ("upper_share", share("q_upper", "q_letters")), ("digit_share", share("q_digits", "q_chars")),
            ("space_share", share("q_spaces", "q_chars")), ("sentence_marks", share("q_marks", "q_n")), ("odd_marks", share("q_odd", "q_chars")),
            ("bars", share("q_bars", "q_n")), ("exclamations", share("q_shouts", "q_n")),
            # Of what a text of its length may have: all words in a short one, a power of the length (Heaps' law) in a long one.
            ("distinct_words", F.when(F.col("q_n") > 0, F.col("q_distinct") / F.least("q_n", 3 * F.pow("q_n", F.lit(0.8)))).otherwise(0.0)),
            ("repeated_neighbours", share("q_doubled", "q_n")), ("distinct_lines", share("q_dlines", "q_nlines")),
            ("line_length", F.when(F.col("q_nlines") > 0, F.col("q_n") / F.col("q_nlines")).otherwise(0.0)), ("words_ending_odd", share("q_oddends", "q_n")),
        ],
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` as the struct ``row``, and the statistics of ``text``."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("q_source"))
    for step in statistics(F.col("q_source")):
        df = df.select("*", *[e.alias(n) for n, e in step])
    return df.select("row", *STATISTICS)


@dataclass(frozen=True)
class RuleEnsemble:
    """``1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))``; a rule is a set of (statistic, over?, bound)."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...] = ()

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = reduce(Column.__and__, [(F.col(s) > F.lit(b)) if over else (F.col(s) <= F.lit(b)) for s, over, b in conditions])
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def described(self) -> list[str]:
        """The rules in words, heaviest first."""
        text = lambda c: " and ".join(f"{s} {'>' if over else '<='} {b:.4g}" for s, over, b in c)
        return [f"{w:+.3f} if {text(c)}" for w, c in sorted(self.rules, key=lambda r: -abs(r[0]))]


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")


def tree_rules(described: str) -> set[tuple[tuple[str, bool, float], ...]]:
    """Every path of a fitted tree, in the text form MLlib gives, as a conjunction with one bound a side of a statistic."""
    path: list[tuple[int, str, bool, float]] = []
    rules = set()
    for line in described.splitlines():
        if m := _SPLIT.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(m[3])], m[4] == ">", float(m[5]))]
            tight: dict = {}
            for _, name, over, bound in path:
                known = tight.get((name, over), bound)
                tight[name, over] = max(known, bound) if over else min(known, bound)
            rules.add(tuple(sorted((n, o, b) for (n, o), b in tight.items())))
    return rules


def drawn(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of ``rows``, by a hash of ``key``; all if there are no more."""
    n = rows.count()
    return rows if n <= sample else rows.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 20)) < (sample << 20) // n)


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Fit to ``labelled`` (``key, text, label``; label 0 or 1).

    If there are more than ``sample`` rows, about that many are drawn.  Null labels are left out.
    Without labels every score is 0.5, with labels of one kind it is their smoothed share.
    """
    rows = with_statistics(drawn(labelled.filter("label in (0, 1)"), sample), ["label"])
    # Few rows by the bound above, hence few partitions: the fits below go over them again and again.
    train = cut(rows.select(F.col("row.label").cast("double").alias("label"), *STATISTICS)).coalesce(4)
    n, good = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return RuleEnsemble(math.log((good + 1) / (n - good + 1)))
    # Both kinds weigh alike while the trees look for rules.
    weighed = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train).withColumn("weight", F.when(F.col("label") == 1, F.lit(n / 2 / good)).otherwise(n / 2 / (n - good)))
    forest = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", bootstrap=False, seed=7, minInstancesPerNode=5
    ).fit(weighed)
    rules = sorted(reduce(set.union, (tree_rules(t.toDebugString) for t in forest.trees), set()))
    if not rules:
        return RuleEnsemble(math.log((good + 1) / (n - good + 1)))
    held = RuleEnsemble(0.0, tuple((1.0, r) for r in rules))
    flags = [reduce(Column.__and__, [(F.col(s) > b) if over else (F.col(s) <= b) for s, over, b in r]).cast("double").alias(f"r{i}") for i, (_, r) in enumerate(held.rules)]
    table_ = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(train.select("label", *flags)).select("label", "features")
    chosen = LogisticRegression(labelCol="label", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(cut(table_))
    weights = [float(w) for w in chosen.coefficients]
    return RuleEnsemble(float(chosen.intercept), tuple((w, r) for w, r in zip(weights, rules) if abs(w) > 1e-6))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` with ``quality_score``: likelihood of label 1.

    Null and empty texts have zero statistics and the score of these; repeated rows and null ids score like any row; a column
    of that name is replaced.
    """
    docs = docs.drop("quality_score")
    return with_statistics(docs, docs.columns).select("row.*", model.column().alias("quality_score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id has no remainder and is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_labelled(documents: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Fit to the labelled documents that are not held out; of several labels of one id the lowest counts."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").alias("label"))
    # Drawn before texts are fetched: the marks are few enough to broadcast, and no text is shuffled.
    few = drawn(cut(marks.filter(~held_out("key"))), SAMPLE)
    return fit(documents.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(few), "key"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality score of every document."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    scored = score(documents, fit_labelled(documents, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
