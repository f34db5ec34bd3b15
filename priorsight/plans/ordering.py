"""Positions and running sums over a global order, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorsight.plans.lineage import cut

_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition above these bits


def with_global_order(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str] = ()) -> DataFrame:
    """Add ``position`` (from 1), ``n_rows`` and, for each of ``sums``, ``run_<c>`` and ``all_<c>``.

    Rows are range-partitioned by ``order`` and written once, so the partition
    borders are fixed; the per-partition totals (one row per partition) are
    accumulated and joined back.  ``order`` should be unique.
    """
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id())
    ).withColumns(
        {
            "part": F.shiftright("slot", _ROW_BITS),
            "nth": F.col("slot").bitwiseAND((1 << _ROW_BITS) - 1) + 1,
        }
    )
    parts = placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("part_rows"), *[F.sum(c).alias(f"part_{c}") for c in sums]
    )
    # One row per shuffle partition: a bound set by the configuration, not by the data.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_rows").over(everything).alias("n_rows"),
        *[F.coalesce(F.sum(f"part_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums],
        *[F.sum(f"part_{c}").over(everything).alias(f"all_{c}") for c in sums],
    )
    joined = placed.join(F.broadcast(offsets), "part")
    inside = Window.partitionBy("part").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *df.columns,
        (F.col("rows_before") + F.col("nth")).alias("position"),
        "n_rows",
        *[(F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the values of a one-row table as constant columns.

    The row is fetched first, as any fitted statistic is, so the plan of ``df``
    gets literals to fold in place of a join without a key.
    """
    row = one_row.first()
    return df.withColumns(
        {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema.fields}
    )
