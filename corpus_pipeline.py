"""From raw documents to piece ids: filter, deduplicate, cut repeats, mix, encode.

A stage needs the columns ``doc_id`` and ``text``, mixing also ``source``; ``n_chars`` follows the text where it is there.  All other columns are
carried along, whatever their names and nulls, and an empty table gives an empty one.  Texts are taken whole at any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorsight.llm import mixing, near_dedup, quality, sentence_pieces, substring_dedup
from priorsight.plans.lineage import checkpoint_dir, remove, shuffles_removed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels, does not reject.

    Null texts are scored as empty ones; equal texts score alike, so repeated rows stay or go together.  A score at the threshold stays.
    """
    model = quality.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    # The number keeps the filter above the score; pushed below, it would make every statistic anew for each rule.
    scored = quality.score(rows, model).select("doc", "quality_score", F.monotonically_increasing_id().alias("number"))
    return scored.filter((F.col("quality_score") >= quality.THRESHOLD) & (F.col("number") >= 0)).select("doc.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, on shingles of five words at 0.8: that with the smallest id.

    Of repeated rows with words one stays; null texts and texts without words are linked with nothing and all stay.  Rows with a
    null id take part, and stay only if no other row of their component has an id.
    """
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 35 words that occur more than once; a text that loses nothing stays as it is.

    Every row stays, also one that loses all its words (its text is then empty); null and short texts have no window.  Repeated
    rows repeat each other's windows, so that both lose them.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    done = substring_dedup.remove_repeats(rows, spread=[F.col("doc.doc_id")])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return done.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; null is a source like others.

    Null texts and texts without words have no size and are never taken.  Equal positions are ordered by reading and id.
    """
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids under merge-dropout; a document that the mix reads again is drawn anew.

    Readings of one document and text are numbered; which of them comes first does not matter, as they are equal.  Null and
    empty texts have nothing to draw, so that they are dealt out instead of meeting; every row stays.
    """
    name = "_reading"
    while name in docs.columns:
        name = "_" + name
    blank = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.monotonically_increasing_id())
    same = Window.partitionBy("doc_id", F.xxhash64("text"), blank).orderBy(F.lit(0))
    numbered = docs.withColumn(name, F.row_number().over(same))
    return sentence_pieces.encode(numbered, sentence_pieces.Pieces.load(), reading=F.col(name)).drop(name)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again.

    A table goes when the next one stands; the last one written stays, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
