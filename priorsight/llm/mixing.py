"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time, 0 to 1.  Its integral says
which part of the source's words is due by when; inverting it gives the moment
at which the n-th word of the source is due.  Documents get the moment of their
first word and are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.plans.ordering import attach_row, with_global_order

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: No source is read more often than this.
MOST_PASSES = 3
#: By turns with the weights: even, early, late. Knots are (time, weight), straight in between.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))


def inverse_schedule(share: str, knots: Sequence[tuple[float, float]]) -> str:
    """SQL for the time by which ``share`` (SQL, 0 to 1) of a source's words is due."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    cases = []
    for (t0, w0), (t1, w1), before, upto in zip(knots, knots[1:], areas, areas[1:]):
        due = f"({share} * {areas[-1]!r}D - {before!r}D)"
        root = f"({w0!r}D + sqrt(greatest({w0 * w0!r}D + {2 * (w1 - w0) / (t1 - t0)!r}D * {due}, 0D)))"
        cases.append(f"when {share} * {areas[-1]!r}D <= {upto!r}D then {t0!r}D + coalesce(2D * {due} / nullif({root}, 0D), 0D)")
    return f"least(case {' '.join(cases)} else 1D end, 1D)"


def position_sql(share: str, schedules: Sequence = SCHEDULES) -> str:
    """SQL for the position of a word of the source numbered ``turn`` at ``share`` of its words."""
    turns = " ".join(f"when {i} then {inverse_schedule(share, s)}" for i, s in enumerate(schedules))
    return f"case (turn - 1) % {len(schedules)} {turns} end"


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, turn, source_size, target`` of every source in ``sized`` (``source, size``); null is a source, the last.

    Targets share all words by weight; none is above ``most`` times its source,
    and what is above goes to the others by weight.  The sources stay
    distributed: their number may grow with the data.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    placed = with_global_order(sizes, ["unnamed", "source"]).withColumnRenamed("position", "turn").drop("n_rows")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    # From the source that is full first: it is full if an even share of what is left would be above it.
    run = with_global_order(placed, ["full_at", "turn"], ["source_size", "weight"])
    run = run.withColumns({
        "words_left": F.col("all_source_size") - most * (F.col("run_source_size") - F.col("source_size")),
        "weight_left": F.col("all_weight") - F.col("run_weight") + F.col("weight"),
    })
    open_ = F.col("words_left") * F.col("weight") <= most * F.col("source_size") * F.col("weight_left")
    first = run.agg(F.min(F.when(open_, F.struct("position", "words_left", "weight_left"))).alias("f")).select(
        F.coalesce("f.position", F.lit(1)).alias("first_open"), F.col("f.words_left").alias("open_words"), F.col("f.weight_left").alias("open_weight")
    )
    run = attach_row(run, first)
    target = F.when(F.col("position") < F.col("first_open"), (most * F.col("source_size")).cast("double")).otherwise(
        F.col("open_words") * F.col("weight") / F.col("open_weight")
    )
    return run.select("source", "turn", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES, schedules: Sequence = SCHEDULES) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text, source``): how many of its words the mix takes, and when the first is due.

    Returns ``doc_id, text_key, size, source_size, target, taken, before, position, turn``.  A source is read in an
    order drawn by hashing ids, again and again until its target is met to the word, so the last document
    read may be taken in part.  ``before`` is the source's words ahead of the document in one reading.

    Null or blank texts have size 0 and take nothing (position null); null sources are one source, the last; null ids
    and repeated rows count like any rows.  An empty table gives no rows.  ``text_key`` tells rows with one id apart.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(
        "doc_id", "source", F.xxhash64("source", "text").alias("text_key"), size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw")
    )
    ordered = with_global_order(sized.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source", "draw", "doc_id", "text_key"], ["size"])
    targets = source_targets(ordered, weights, most)
    # Sources lie one after another in the order, so a source starts where those before it end.
    placed = with_global_order(targets, ["turn"], ["source_size"]).select(
        F.col("source").alias("of_source"), "turn", "source_size", "target", (F.col("run_source_size") - F.col("source_size")).alias("source_start")
    )
    joined = ordered.join(placed, F.col("source").eqNullSafe(F.col("of_source")))
    words, passes = F.round("target").cast("long"), F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))
    out = joined.withColumn("before", F.col("run_size") - F.col("size") - F.col("source_start")).withColumn("words", words).withColumn("passes", passes)
    rest = F.col("words") - F.col("passes") * F.col("source_size") - F.col("before")
    out = out.withColumn("taken", F.col("passes") * F.col("size") + F.greatest(F.least(rest, F.col("size")), F.lit(0)))
    share = "(cast(before as double) / nullif(words, 0))"
    return out.withColumn("position", F.when(F.col("taken") > 0, F.expr(position_sql(share, schedules)))).select(
        "doc_id", "text_key", "size", "source_size", "target", "taken", "before", "position", "turn"
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES, schedules: Sequence = SCHEDULES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by position; same columns.

    A document read in part keeps the words taken, joined by one space, and ``n_chars`` follows its text.  Each
    row of ``docs`` is shuffled once to meet its readings and once to be sorted.
    """
    plan = mix(docs, weights, most, schedules)
    reads = plan.filter("taken > 0").withColumn("reading", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    share = "(cast(before + reading * source_size as double) / round(target))"
    reads = reads.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), F.expr(position_sql(share, schedules)).alias("due"),
        F.least(F.col("taken") - F.col("reading") * F.col("size"), F.col("size")).alias("keep"), F.col("size").alias("whole"), "reading",
    )
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("in_doc"), F.xxhash64("source", "text").alias("in_text"))
    met = keyed.dropDuplicates(["in_doc", "in_text"]).join(reads, F.col("in_doc").eqNullSafe(F.col("of_doc")) & (F.col("in_text") == F.col("of_text")))
    words = F.slice(F.regexp_extract_all("row.text", F.lit(WORD), 0), F.lit(1), F.greatest("keep", F.lit(1)).cast("int"))
    met = met.withColumn("read", F.when(F.col("keep") < F.col("whole"), F.array_join(words, " ")).otherwise(F.col("row.text")))
    changed = {"text": F.col("read"), "n_chars": F.length("read").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("read")}
    return met.orderBy("due", "reading", "of_doc").select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _sql() -> str:
    turns = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
    position = position_sql("(cast(before as double) / nullif(words, 0))").replace("D", "")
    return f"""with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as draw from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as turn from sized group by source),
weighed as (select *, case (turn - 1) % {len(WEIGHTS)} {turns} end as weight from sources),
run as (select *, row_number() over o as p, sum(source_size) over () - {MOST_PASSES} * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) as words_left,
    sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as weight_left
    from weighed window o as (order by {MOST_PASSES} * source_size / weight, turn)),
cut as (select p as first_open, words_left as open_words, weight_left as open_weight from run
    where words_left * weight <= {MOST_PASSES} * source_size * weight_left order by p limit 1),
targets as (select source, turn, source_size, case when p < first_open then {MOST_PASSES} * source_size::double else open_words::double * weight / open_weight end as target from run, cut),
placed as (select d.*, t.turn, t.source_size, t.target, cast(round(t.target) as bigint) as words,
    sum(d.size) over (partition by d.source order by d.draw, d.doc_id rows between unbounded preceding and current row) - d.size as before
    from sized d join targets t on d.source is not distinct from t.source),
taken as (select *, cast(words // greatest(source_size, 1) * size
    + greatest(least(words - words // greatest(source_size, 1) * source_size - before, size), 0) as bigint) as taken from placed)
select doc_id, size::bigint as size, source_size, round(target, 6) as target, taken, round(case when taken > 0 then {position} end, 6) as position from taken"""


@query("op9_mixing", _sql())
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, in the order in which the mix first reads them."""
    mixed = mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position")).orderBy("position", "doc_id")
