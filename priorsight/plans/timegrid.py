"""Skew-safe running totals along the time line of a key.

A window over a whole key puts all rows of that key into one task.  Here the
time line of every key is cut into cells of a fixed width; each cell is summed
with map-side combine, the cell sums are accumulated per key, and the total
carried into a cell is added as one more row of that cell.  A task then only
ever sorts one cell, whatever share of the data its key holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DAY_US = 86_400_000_000

# Cell widths to choose from, all divisors of a day.
CELL_WIDTHS = tuple(DAY_US // n for n in (1, 4, 24, 144, 1_440, 8_640, 86_400, 864_000, 8_640_000))

CELL_ROWS = 500_000

# Rows of one instant are told apart by this many lanes where even the finest
# cells are too full, as when a third of a log carries the same time.
INSTANT = 0
LANES = 65_536


def measure_widths(
    rows: DataFrame | Sequence[DataFrame], keys: Sequence[str], us: str = "us", cell_rows: int | None = None
) -> tuple[int, ...]:
    """Cell widths (finest first) under which no cell of a key holds more than ``cell_rows`` rows.

    ``rows`` are all tables that will share the cells.  One counting job per
    tried width, over the key and time columns only.  If already every whole
    key is that small, a single job shows it and no cells are needed.
    """
    cell_rows = cell_rows or CELL_ROWS
    tables = [rows] if isinstance(rows, DataFrame) else list(rows)
    lines = reduce(DataFrame.unionAll, [t.select(*keys, F.col(us).alias("us")) for t in tables])

    def fullest(*cell) -> int:
        return lines.groupBy(*keys, *cell).count().agg(F.max("count").alias("n")).first()["n"] or 0

    def fullest_of(width: int) -> int:
        return fullest(F.expr(f"us div {width}").alias("cell"))

    if fullest() <= cell_rows:
        return ()
    peak = fullest_of(DAY_US)
    width = DAY_US
    while peak > cell_rows and width > CELL_WIDTHS[-1]:
        wanted = width * cell_rows // peak
        finer = [w for w in CELL_WIDTHS if w < width]
        width = next((w for w in finer if w <= wanted), finer[-1])
        peak = fullest_of(width)
    # Day cells above finer ones keep the per-key list of cells short as well;
    # a minute in between does so for very fine ones.
    above = [w for w in (DAY_US // 1_440, DAY_US) if width < w and (w == DAY_US or w // width > 1_000)]
    return (*((INSTANT,) if peak > cell_rows else ()), width, *above)


def has_instants(widths: Sequence[int]) -> bool:
    return bool(widths) and widths[0] == INSTANT


def with_lane(rows: DataFrame, widths: Sequence[int], *identity: str) -> DataFrame:
    """Add the ``lane`` that instant cells need; ``identity`` tells rows of one instant apart."""
    if not has_instants(widths):
        return rows
    return rows.withColumn("lane", F.pmod(F.xxhash64(*identity), F.lit(LANES)))


def _total(name: str, kind: DataType, frame: WindowSpec) -> Column:
    return F.coalesce(F.sum(name).over(frame), F.lit(0).cast(kind)).cast(kind)


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str],
    widths: Sequence[int],
    us: str = "us",
    tie: Sequence[str] = (),
    ahead: str | None = None,
    upto_row: int = Window.currentRow,
) -> DataFrame:
    """Add ``run_<c>``: the sum of ``c`` over all rows of the key up to and with this one.

    Rows are ordered by ``us`` and the ``tie`` columns.  ``sums`` must be
    non-null integers or decimals, so that the result is exact in any order of
    addition.  ``ahead`` names a column that never falls along the time line;
    its value on the next row of the key is added as ``next_<ahead>``.
    ``upto_row`` of -1 leaves the row itself out.  Instant cells need the
    column of ``with_lane``.
    """
    run = [f"run_{c}" for c in sums]
    schema = rows.schema
    kinds = {c: schema[c].dataType for c in sums}
    if not widths:
        line = Window.partitionBy(*keys).orderBy(us, *tie)
        upto = line.rowsBetween(Window.unboundedPreceding, upto_row)
        extra = [F.lead(ahead).over(line).alias(f"next_{ahead}")] if ahead else []
        return rows.select("*", *[_total(c, kinds[c], upto).alias(r) for c, r in zip(sums, run)], *extra)

    body = f"body{len(widths)}"
    if widths[0] == INSTANT:
        cell_name = None
        below = (*tie, "lane")
        cell = [*keys, us, *below]
        sizes = []
    else:
        cell_name = f"cell{len(widths)}"
        below = ()
        cell = [*keys, cell_name]
        sizes = [F.min(us).alias(us)]
        rows = rows.withColumn(cell_name, F.expr(f"`{us}` div {widths[0]}"))
    firsts = [F.min(ahead).alias(ahead)] if ahead else []
    cells = rows.groupBy(*cell).agg(*sizes, *firsts, *[F.sum(c).cast(kinds[c]).alias(c) for c in sums])
    carried = running_totals(cells, keys, sums, widths[1:], us, below, ahead, -1)
    carry = carried.select(
        *cell,
        F.lit(False).alias(body),
        *[F.col(r).alias(c) for c, r in zip(sums, run)],
        *([F.col(f"next_{ahead}").alias("next_cell")] if ahead else []),
    )
    line = Window.partitionBy(*cell).orderBy(body, us, *tie)
    upto = line.rowsBetween(Window.unboundedPreceding, upto_row)
    sofar = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn(body, F.lit(True)).unionByName(carry, allowMissingColumns=True)
    extra = []
    if ahead:
        extra = [
            F.coalesce(F.lead(ahead).over(line), F.max("next_cell").over(sofar)).alias(f"next_{ahead}")
        ]
    out = both.select("*", *[_total(c, kinds[c], upto).alias(r) for c, r in zip(sums, run)], *extra)
    dropped = [c for c in (cell_name, body, "next_cell" if ahead else None) if c]
    return out.filter(F.col(body)).drop(*dropped)


def last_rows_before(
    events: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    k: int,
    widths: Sequence[int],
    order: str,
    us: str = "us",
) -> DataFrame:
    """For every query row the ``k`` latest events of its key strictly before its time.

    Adds ``last_0 .. last_{k-1}``, structs of ``us`` and the payload, newest
    first, null where there are fewer.  Events at the same time are ordered by
    ``order``.  The rows that cross a cell border are at most ``k`` per cell.
    """
    events = events.dropna(subset=list(keys))
    if has_instants(widths):
        # No more than k events of an instant matter, and its queries all get the same answer.
        latest = Window.partitionBy(*keys, us).orderBy(F.desc(order))
        events = events.withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= k).drop("nth")
        points = queries.select(*keys, us).distinct()
        answered = last_rows_before(events, points, keys, payload, k, widths[1:], order, us)
        return queries.join(answered, [*keys, us], "left").select(*queries.columns, *[f"last_{i}" for i in range(k)])

    cell = [*keys, "cell"] if widths else list(keys)
    place = [F.expr(f"(`{us}` - pmod(`{us}`, {widths[0]}L)) div {widths[0]}").alias("cell")] if widths else []
    record = F.struct(F.col(us).alias("us"), F.col(order).alias("event_order"), *payload).alias("event")
    happened = events.select(*keys, us, *place, record)
    asked = queries.select("*", *place)
    if widths:
        happened = happened.unionByName(_carried_events(events, asked, keys, payload, k, widths, order, us))
    rows = (
        happened.withColumn("is_event", F.lit(True))
        .unionByName(asked.withColumn("is_event", F.lit(False)), allowMissingColumns=True)
        .withColumn("event_order", F.col("event.event_order"))
    )
    over = "over (partition by {} order by `{}`, is_event, event_order)".format(
        ", ".join(f"`{c}`" for c in cell), us
    )
    picked = rows.select(
        "*", *[F.expr(f"lag(event, {i + 1}) ignore nulls {over}").alias(f"last_{i}") for i in range(k)]
    )
    return picked.filter(~F.col("is_event")).select(
        *queries.columns, *[f"last_{i}" for i in range(k)]
    )


def _carried_events(
    events: DataFrame, asked: DataFrame, keys: Sequence[str], payload: Sequence[str], k: int, widths: Sequence[int], order: str, us: str
) -> DataFrame:
    """For every cell with queries, the ``k`` latest events of the cells before it.

    A cell's own latest events are few; what precedes a cell is the same question about them, asked at its start and
    over the next coarser cells, so that no task sees all cells of a key.
    """
    width = widths[0]
    start = F.expr(f"`{us}` - pmod(`{us}`, {width}L)")
    newest = Window.partitionBy(*keys, "cell").orderBy(F.desc(us), F.desc(order))
    tails = events.withColumn("cell", start).withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= k)
    tails = tails.select(*dict.fromkeys([*keys, us, order, *payload]))
    starts = asked.select(*keys, start.alias(us)).distinct()
    carried = last_rows_before(tails, starts, keys, payload, k, widths[1:], order, us)
    return (
        carried.select(*keys, F.expr(f"`{us}` div {width}").alias("cell"), F.explode(F.array(*[f"last_{i}" for i in range(k)])).alias("event"))
        .filter(F.col("event").isNotNull())
        .withColumn(us, F.col("event.us"))
    )
