"""Exact nearest-neighbour vote by boxes along principal axes.

Vectors fall into the leaves of a tree of splits along the principal axes of
drawn rows; neighbouring leaves form blocks.  A query first looks into its own
block, which bounds the distance of its k-th neighbour, and then only into the
blocks whose bounding box is that near.  Inside a block the same is done with
small leaves, and the leading axes rule out most rows of a leaf that is met.
Large leaves and many queries are both split, and a block hands on k candidates
per query, never its pairs.  ``search_cells`` does the same for given cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorsight.functions.scalars import hashed_unit
from priorsight.plans.lineage import cut

#: Rows drawn for axes and splits, at most; rows of a leaf inside a block; leaves that a query meets one by one before all others that may matter;
#: the share of all variance that the leading axes hold.
DRAWN, LEAF, ROUNDS, LEADING = 4_096, 512, 3, 0.9
#: Rows of a block and numbers in its vectors, at most about; blocks and chunks that a search has at least, if they hold ``LEAST`` rows.
BLOCK_ROWS, BLOCK_NUMBERS, BLOCKS, CHUNKS, LEAST = 65_536, 1 << 22, 8, 4, 1_024
SLACK = 1e-9
CHUNK_NUMBERS = 1_000_000
#: Cells whose sizes are sent to every task; more are joined by cell.
SENT_CELLS = 500_000
_FOUND = "query long, neighbour long, distance double"


def stacked(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if flat.null_count or len(np.unique(flat.value_lengths().to_numpy(zero_copy_only=False))) > 1:
        raise ValueError("a vector is null, or vectors differ in length")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """For every element of the lists, the row it belongs to and its value."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


class _Nearest:
    """The ``k`` nearest found so far of many queries; ``limit`` is the square of a distance beyond which nothing can be among them.

    ``distinct`` counts a key that is found several times at one distance once.
    """

    def __init__(self, k: int, limit: np.ndarray, distinct: bool):
        self.k, self.limit, self.distinct = k, limit, distinct
        self.distance = np.full((len(limit), k), np.inf)
        self.key = np.zeros((len(limit), k), np.int64)

    def add(self, which: np.ndarray, key: np.ndarray, distance: np.ndarray) -> None:
        some = np.unique(which)
        old = np.isfinite(self.distance[some])
        which = np.concatenate((which, np.repeat(some, old.sum(axis=1))))
        key, distance = np.concatenate((key, self.key[some][old])), np.concatenate((distance, self.distance[some][old]))
        order = np.lexsort((key, distance, which))
        which, key, distance = which[order], key[order], distance[order]
        if self.distinct:
            fresh = np.ones(len(which), bool)
            fresh[1:] = (which[1:] != which[:-1]) | (key[1:] != key[:-1]) | (distance[1:] != distance[:-1])
            which, key, distance = which[fresh], key[fresh], distance[fresh]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        best = nth < self.k
        self.distance[which[best], nth[best]], self.key[which[best], nth[best]] = distance[best], key[best]
        self.limit[some] = np.minimum(self.limit[some], np.square(self.distance[some, -1]) * (1 + SLACK))


def _search_tile(k: int, distinct: bool = False):
    """The ``k`` nearest of a block to each query of a chunk, cell by cell: by squared norms and a product in single precision, the few that can matter then exactly."""

    def search(base: pa.Table, asked: pa.Table) -> pa.Table:
        order = np.argsort(base["place"].to_numpy(), kind="stable")
        matrix, keys = _matrix(base["vector"])[order], base["key"].to_numpy()[order]
        places, starts = np.unique(base["place"].to_numpy()[order], return_index=True)
        vectors, queries = _matrix(asked["vector"]), asked["query"].to_numpy()
        # Seen from the middle and with lengths of one at most, numbers fit single precision; what is not finite is compared as it is.
        middle = matrix.mean(axis=0)
        scale = np.sqrt(max(np.square(matrix - middle).sum(axis=1).max(), np.square(vectors - middle).sum(axis=1).max()))
        single = bool(np.isfinite(scale) and scale > 0)
        kind, error = (np.float32, 2.4e-7) if single else (np.float64, 1e-12)
        middle, scale = (middle, scale) if single else (0.0, 1.0)
        base_as, asked_as = (matrix - middle) / scale, (vectors - middle) / scale
        norms, own = (base_as**2).sum(axis=1), (asked_as**2).sum(axis=1)
        base_as, asked_as = base_as.astype(kind), asked_as.astype(kind)
        nearest = _Nearest(k, np.square(asked["bound"].to_numpy()) * (1 + SLACK), distinct)
        row, opened = _lists(asked["places"].combine_chunks())
        order = np.argsort(opened, kind="stable")
        row, opened = row[order], opened[order]
        for place, start, end in zip(places, starts, [*starts[1:], len(keys)]):
            visitors = row[np.searchsorted(opened, place) : np.searchsorted(opened, place, "right")]
            cell, step = matrix[start:end], max(1, CHUNK_NUMBERS // (end - start))
            for at in range(0, len(visitors), step):
                some = visitors[at : at + step]
                rough = asked_as[some] @ base_as[start:end].T
                rough *= -2
                rough += norms[start:end].astype(kind)
                # Twice the rounding error of the products keeps every row that may be among the nearest, ties included.
                slack = error * (matrix.shape[1] + 8) * (own[some] + norms[start:end].max()) + 1e-30
                limit = nearest.limit[some] / scale**2 - own[some]
                free = np.isinf(limit)
                if free.any() and end - start > k:
                    limit[free] = np.partition(rough[free], k - 1, axis=1)[:, k - 1]
                which, near = np.divmod(np.flatnonzero(rough <= (limit + slack).astype(kind)[:, None]), end - start)
                distance = np.empty(len(near))
                part = max(1, CHUNK_NUMBERS // matrix.shape[1])
                for i in range(0, len(near), part):
                    apart = vectors[some[which[i : i + part]]] - cell[near[i : i + part]]
                    distance[i : i + part] = np.sqrt((apart * apart).sum(axis=1))
                if len(near):
                    nearest.add(some[which], keys[start:end][near], distance)
        which, nth = np.nonzero(np.isfinite(nearest.distance))
        return pa.table({"query": queries[which], "neighbour": nearest.key[which, nth], "distance": nearest.distance[which, nth]})

    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        if base.num_rows and asked.num_rows:
            return search(base, asked)
        return pa.table({"query": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    return run


def best_of(candidates: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query").orderBy("distance", "neighbour")
    return candidates.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k)


@dataclass
class _Blocks:
    """Cells in order, dealt to blocks of ``rows`` rows; a cell with more goes to ``parts`` blocks from ``first`` on."""

    cells: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, sizes: np.ndarray, rows: int) -> _Blocks:
        return cls(cells, (np.cumsum(sizes) - sizes) // rows, -(-sizes // rows))

    def visited(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some rows of a batch at a time: the row, block and place of every visit, by row and block."""
        step = max(1, 2 * CHUNK_NUMBERS * batch.num_rows // max(1, len(batch["cells"].flatten())))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            row, cell = _lists(some["cells"])
            place = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            held = self.cells[place] == cell
            row, place = row[held], place[held]
            parts = self.parts[place]
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            row, place = np.repeat(row, parts), np.repeat(place, parts)
            block = self.first[place] + nth
            by = row * int(self.first[-1] + self.parts[-1]) + block
            if (by[1:] < by[:-1]).any():
                order = np.argsort(by, kind="stable")
                row, block, place = row[order], block[order], place[order]
            yield some, row, block, place

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``place, block, n``: how many visits a place has, and how many rows visit a block."""
        places, blocks = np.zeros(len(self.cells), np.int64), np.zeros(int(self.first[-1] + self.parts[-1]), np.int64)
        for batch in batches:
            for _, row, block, place in self.visited(batch):
                np.add.at(places, np.unique(place), 1)
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
                blocks += np.bincount(block[fresh], minlength=len(blocks))
        for name, counts in (("place", places), ("block", blocks)):
            at = np.flatnonzero(counts)
            yield pa.record_batch({"kind": pa.array([name] * len(at), pa.string()), "id": at, "n": counts[at]})

    def routed(self, chunks: np.ndarray):
        """Every query once to each block that it visits, with the places that it opens there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some, row, block, place in self.visited(batch):
                    starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))) if len(row) else np.zeros(0, np.int64)
                    # Not all rows of a batch of queries at once: a query of many blocks comes as often.
                    for at in range(0, len(starts), 1 << 12):
                        own = starts[at : at + (1 << 12)]
                        end = starts[at + (1 << 12)] if at + (1 << 12) < len(starts) else len(row)
                        kept, to = some.select(["query", "vector", "bound"]).take(pa.array(row[own])), block[own]
                        drawn = kept["query"].to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                        opened = pa.ListArray.from_arrays(pa.array(np.append(own - own[0], end - own[0]).astype(np.int32)), pa.array(place[own[0] : end].astype(np.int32)))
                        yield pa.record_batch({"block": to, "chunk": (drawn % chunks[to].astype(np.uint64)).astype(np.int32), **{c: kept[c] for c in kept.schema.names}, "places": opened})

        return run


def search_cells(placed: DataFrame, visits: DataFrame, k: int, block_rows: int = BLOCK_ROWS, distinct: bool = False) -> DataFrame:
    """``query, neighbour, distance``: the ``k`` nearest rows of ``placed`` (key, vector, cell) in the cells that ``visits`` (query, vector, cell) open.

    A visit opens one ``cell`` or several, ``cells``; nothing farther than ``bound`` is sought, if there is such a column.  Cells are put into blocks, large
    ones split, and the many visitors of a block are dealt to chunks; each chunk meets its block once, so a vector goes to
    a block and not to each of its cells.  Rows of a cell that nobody visits are not sent at all.  ``distinct`` is for rows
    that are placed in several cells: one that is found in several is one of the ``k``.
    """
    spark = placed.sparkSession
    opened = visits.select(
        "query", F.col("vector").cast("array<double>").alias("vector"), (F.col("bound") if "bound" in visits.columns else F.lit(float("inf"))).alias("bound"),
        F.col("cells" if "cells" in visits.columns else "cell").alias("cells"),
    )
    if "cells" not in visits.columns:
        opened = opened.withColumn("cells", F.array("cells"))
    grid = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("numbers")))
    if grid.count() > SENT_CELLS:
        return _search_by_cell(placed, opened, grid, k, block_rows, distinct)
    sizes = grid.select(F.col("cell").cast("long"), "rows", "numbers").orderBy("cell").toArrow()
    if not sizes.num_rows:
        return spark.createDataFrame([], _FOUND)
    cells, rows = sizes["cell"].to_numpy(), sizes["rows"].to_numpy()
    most = max(1, min(block_rows, BLOCK_NUMBERS // max(1, sizes["numbers"].to_numpy().max())))
    blocks = _Blocks.of(cells, rows, min(most, max(LEAST, int(rows.sum()) // BLOCKS)))
    counts = opened.select("cells").mapInArrow(blocks.counted, "kind string, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).toArrow()
    kinds, ids, n = counts["kind"].to_numpy(zero_copy_only=False), counts["id"].to_numpy(), counts["n"].to_numpy()
    chunks = np.zeros(int(blocks.first[-1] + blocks.parts[-1]), np.int64)
    askers = n[kinds == "block"]
    chunks[ids[kinds == "block"]] = -(-askers // np.minimum(most, np.maximum(LEAST, askers // CHUNKS)))
    visited = np.sort(ids[kinds == "place"])
    near = spark.createDataFrame(pa.table({"cell": cells[visited], "place": visited.astype(np.int32), "first": blocks.first[visited], "parts": blocks.parts[visited]}))
    often = spark.createDataFrame(pa.table({"block": np.arange(len(chunks)), "chunks": chunks}))
    side = placed.join(F.broadcast(near), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")))
    side = side.join(F.broadcast(often), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    asked = opened.mapInArrow(blocks.routed(chunks), "block long, chunk int, query long, vector array<double>, bound double, places array<int>")
    by = ["block", "chunk"]
    side = side.select("block", "chunk", F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"), "place")
    return side.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search_tile(k, distinct), _FOUND)


def _search_by_cell(placed: DataFrame, opened: DataFrame, grid: DataFrame, k: int, block_rows: int, distinct: bool) -> DataFrame:
    """As ``search_cells``, for more cells than are sent to every task: each visit goes to its cell."""
    visits = opened.select("query", "vector", "bound", F.explode("cells").alias("cell"))
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    askers = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("askers"))
    near = cut(grid.join(askers, "cell").select("cell", blocks("rows").alias("parts"), blocks("askers").alias("chunks")))
    place = F.lit(0).alias("place")
    side = placed.join(near, "cell").select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"), "cell", one("key", "parts").alias("part"), every("chunks").alias("chunk"), place)
    asked = visits.join(near, "cell").select("query", "vector", "bound", "cell", one("query", "chunks").alias("chunk"), every("parts").alias("part"), F.array(place).alias("places"))
    by = ["cell", "part", "chunk"]
    return side.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search_tile(k, distinct), _FOUND)


@dataclass
class _Axes:
    """Principal axes of drawn vectors, most varied first, the number of ``leading`` ones, and a tree of splits along them."""

    middle: np.ndarray
    turn: np.ndarray
    leading: int
    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, drawn: np.ndarray, depth: int) -> _Axes:
        middle = drawn.mean(axis=0)
        size = np.abs(drawn - middle).max() or 1.0
        varied, turn = np.linalg.eigh(np.cov((drawn - middle).T / size, bias=True).reshape(drawn.shape[1], -1))
        varied, turn = np.maximum(varied[::-1], 0), np.ascontiguousarray(turn[:, ::-1])
        leading = int(np.searchsorted(np.cumsum(varied), LEADING * varied.sum())) + 1
        axis, cut_at, parts = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), [(drawn - middle) @ turn]
        for node in range(len(axis)):
            x = parts[node]
            if len(x) > 1:
                axis[node] = x.var(axis=0).argmax()
                cut_at[node] = np.median(x[:, axis[node]])
            right = x[:, axis[node]] > cut_at[node]
            parts += [x[~right], x[right]]
            parts[node] = None
        return cls(middle, turn, min(leading, drawn.shape[1]), axis, cut_at)

    def turned(self, matrix: np.ndarray) -> np.ndarray:
        return (matrix - self.middle) @ self.turn

    def error(self, *turned: np.ndarray) -> float:
        """More than rounding can move a distance of turned vectors."""
        return 1e-14 * len(self.middle) * (np.abs(self.middle).max() + max(np.abs(x).max(initial=0.0) for x in turned))

    def leaf(self, matrix: np.ndarray) -> np.ndarray:
        x, node = self.turned(matrix), np.zeros(len(matrix), np.int64)
        while len(node) and node[0] < len(self.axis):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def placed(self, name: str):
        """Rows with the leaf that they fall into; a vector that is not finite is near to nothing."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    matrix = _matrix(batch["vector"])
                    finite = np.isfinite(matrix).all(axis=1)
                    some = batch if finite.all() else batch.filter(pa.array(finite))
                    yield pa.record_batch({name: some[name], "vector": some["vector"], "leaf": self.leaf(matrix[finite]).astype(np.int32)})

        return run

    def boxes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every block in a partition, the least and largest numbers along the axes."""
        low, high = {}, {}
        for batch in batches:
            order = np.argsort(batch["block"].to_numpy(), kind="stable")
            blocks, starts = np.unique(batch["block"].to_numpy()[order], return_index=True)
            if len(blocks):
                x = self.turned(_matrix(batch["vector"]))[order]
                for block, a, b in zip(blocks.tolist(), np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)):
                    low[block], high[block] = np.minimum(a, low.get(block, a)), np.maximum(b, high.get(block, b))
        for block in low:
            yield pa.record_batch({"block": pa.array([block], pa.int64()), "low": pa.array([low[block]]), "high": pa.array([high[block]])})


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from boxes (rows) to points (columns)."""
    total = np.zeros((len(low), len(x)), x.dtype)
    side, other = np.empty_like(total), np.empty_like(total)
    for at, a, b in zip(x.T, low.T, high.T):
        np.subtract(a[:, None], at[None, :], out=side)
        np.subtract(at[None, :], b[:, None], out=other)
        np.maximum(side, other, out=side)
        np.maximum(side, 0, out=side)
        np.multiply(side, side, out=side)
        total += side
    return total


def _leaves(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and where leaves of at most ``most`` begin in it: halves along the most varied axis."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        axis = x[rows].var(axis=0).argmax()
        order = np.argpartition(x[rows, axis], len(rows) // 2)
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    sizes = np.array([len(rows) for rows in done])
    return np.concatenate(done), np.cumsum(sizes) - sizes


def _nearest_in(axes: _Axes, k: int, base: pa.Table, asked: pa.Table) -> _Nearest:
    """The ``k`` nearest of a block to each query of a chunk.

    Rows of the block are put into leaves, of which a query meets those whose box is near enough, the nearest first.  There, what the leading
    axes in single precision do not rule out is compared exactly, by the vectors as they came.
    """
    vectors, limit = _matrix(asked["vector"]), np.square(asked["bound"].to_numpy()) * (1 + SLACK)
    nearest = _Nearest(k, limit, False)
    if not base.num_rows or not asked.num_rows:
        return nearest
    matrix = _matrix(base["vector"])
    x, y = (axes.turned(m)[:, : axes.leading] for m in (vectors, matrix))
    order, starts = _leaves(y, max(LEAF, 4 * k))
    # A key that is null stays the least number, and others keep all their digits.
    matrix, y, keys = matrix[order], y[order], base["key"].fill_null(np.iinfo(np.int64).min).to_numpy()[order]
    ends = np.append(starts[1:], len(keys))
    # Seen from the middle and with lengths of one at most, numbers fit single precision; others stay double.
    middle = y.mean(axis=0)
    scale = np.sqrt(max(np.square(y - middle).sum(axis=1).max(), np.square(x - middle).sum(axis=1).max()))
    single = bool(np.isfinite(scale) and scale > 0)
    kind, unit = (np.float32, 2.4e-7) if single else (np.float64, 1e-12)
    error = axes.error(x, y)
    middle, scale = (middle, scale) if single else (0.0, 1.0)
    x, y = (x - middle) / scale, (y - middle) / scale
    own, norms, error = np.square(x).sum(axis=1), np.square(y).sum(axis=1), error / scale
    x, y = x.astype(kind), y.astype(kind)
    # One product gives the squared distance less the query's own square.
    x_as, y_as = np.column_stack((x, np.ones(len(x), kind))), np.column_stack((-2 * y, norms.astype(kind))).T
    rounding = unit * (axes.leading + 9) * (own + norms.max()) + 8 * error * (np.sqrt(own) + np.sqrt(norms.max()) + error) + 1e-30
    low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)

    def apart(some: np.ndarray, near: np.ndarray) -> np.ndarray:
        out, part = np.empty(len(near)), max(1, CHUNK_NUMBERS // matrix.shape[1])
        for i in range(0, len(near), part):
            away = vectors[some[i : i + part]] - matrix[near[i : i + part]]
            out[i : i + part] = np.sqrt((away * away).sum(axis=1))
        return out

    def meet(leaf: int, visitors: np.ndarray) -> None:
        start, end = starts[leaf], ends[leaf]
        for at in range(0, len(visitors), max(1, CHUNK_NUMBERS // (end - start))):
            some = visitors[at : at + max(1, CHUNK_NUMBERS // (end - start))]
            rough = x_as[some] @ y_as[:, start:end]
            free = np.flatnonzero(np.isinf(nearest.limit[some]))
            if len(free) and end - start > k:
                # Any k rows bound the k-th distance; these are likely to be near.
                likely = start + np.argpartition(rough[free], k - 1, axis=1)[:, :k]
                far = apart(np.repeat(some[free], k), likely.ravel()).reshape(-1, k).max(axis=1)
                nearest.limit[some[free]] = np.square(far) * (1 + SLACK)
            most = (nearest.limit[some] / scale**2 - own[some] + rounding[some]).astype(kind)
            which, near = np.divmod(np.flatnonzero(rough <= np.nextafter(most, kind(np.inf))[:, None]), end - start)
            which, near = some[which], start + near
            distance = apart(which, near)
            kept = np.square(distance) <= nearest.limit[which]
            if kept.any():
                nearest.add(which[kept], keys[near[kept]], distance[kept])

    step = max(1, 4 * CHUNK_NUMBERS // len(starts))
    for at in range(0, len(x), step):
        inside = slice(at, at + step)
        reach = np.sqrt(_to_boxes(x[inside], low, high)) - kind(4 * unit * (axes.leading + 1) + 4 * error)
        reach = np.square(np.maximum(reach, 0, out=reach), out=reach)
        queries, met = np.arange(at, at + reach.shape[1]), np.zeros(reach.shape, bool)
        for _ in range(min(ROUNDS, len(starts))):
            first = np.where(met, np.inf, reach).argmin(axis=0)
            first[~(reach[first, queries - at] <= nearest.limit[inside] / scale**2)] = -1
            order = np.argsort(first, kind="stable")
            leaves, begins = np.unique(first[order], return_index=True)
            for leaf, some in zip(leaves, np.split(order, begins[1:])):
                if leaf >= 0:
                    met[leaf, some] = True
                    meet(leaf, queries[some])
        for leaf in range(len(starts)):
            some = np.flatnonzero((reach[leaf] <= nearest.limit[inside] / scale**2) & ~met[leaf])
            if len(some):
                meet(leaf, queries[some])
    return nearest


def _found_at_home(axes: _Axes, k: int, blocks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The ``k`` nearest of a query's own block, and the other blocks that can hold something nearer: ``query, vector, bound, others, found``."""
    error = axes.error(low, high)

    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        nearest = _nearest_in(axes, k, base, asked)
        far, found = nearest.distance[:, -1], np.isfinite(nearest.distance)
        x, others, counts, step = axes.turned(_matrix(asked["vector"])), [], [], max(1, 4 * CHUNK_NUMBERS // len(blocks))
        elsewhere = blocks != (asked["block"][0].as_py() if asked.num_rows else -1)
        for at in range(0, len(x), step):
            reach = np.sqrt(_to_boxes(x[at : at + step], low, high)).T
            opened = ~(reach > far[at : at + step, None] * (1 + SLACK) + error + axes.error(x[at : at + step])) & elsewhere
            counts.append(opened.sum(axis=1))
            others.append(blocks[np.nonzero(opened)[1]])
        lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values)
        pairs = pa.StructArray.from_arrays([pa.array(nearest.key[found]), pa.array(nearest.distance[found])], ["neighbour", "distance"])
        return pa.table({
            "query": asked["query"], "vector": asked["vector"], "bound": far, "found": lists(found.sum(axis=1), pairs),
            "others": lists(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.array(np.concatenate(others) if others else np.zeros(0, np.int64), pa.int64())),
        })

    return run


def _found_elsewhere(axes: _Axes, k: int):
    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        nearest = _nearest_in(axes, k, base, asked)
        which, nth = np.nonzero(np.isfinite(nearest.distance))
        return pa.table({"query": asked["query"].take(pa.array(which)), "neighbour": nearest.key[which, nth], "distance": nearest.distance[which, nth]})

    return run


def _in_chunks(side: DataFrame, asked: DataFrame, most: int):
    """Rows and their visitors by block and chunk: so many chunks a block that none has more than ``most`` visitors, nearly; unvisited blocks stay out."""
    spark = side.sparkSession
    counts = asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).toArrow()
    askers = counts["n"].to_numpy()
    often = F.broadcast(spark.createDataFrame(pa.table({"block": counts["block"], "chunks": -(-askers // np.minimum(most, np.maximum(LEAST, askers // CHUNKS)))}), "block long, chunks long"))
    rows = side.join(often, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))).drop("chunks")
    visitors = asked.join(often, "block").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).drop("chunks")
    return rows.groupBy("block", "chunk").cogroup(visitors.groupBy("block", "chunk"))


def nearest_neighbours(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, neighbour, distance, nth`` for the ``k`` nearest base rows by Euclidean distance.

    Both sides have ``key`` (long) and ``vector`` (array of numbers); equal
    distances are ordered by key.  Vectors that are not finite are near to nothing.
    """
    spark = base.sparkSession
    rows = base.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    n, one = rows.count(), rows.select(F.size("vector")).first()
    if not n:
        return spark.createDataFrame([], f"{_FOUND}, nth int")
    numbers = max(1, one[0])
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // numbers))
    # The tree needs no more than a few leaves to a block; drawn rows are held by the driver and its splits by every task.
    draws, unit = max(1, min(DRAWN, BLOCK_NUMBERS // numbers)), hashed_unit(F.col("key"), "pivot")
    drawn = rows if n <= draws else rows.filter(unit < 2 * draws / n)
    taken = drawn.orderBy(unit, "key").limit(draws).select("vector").toArrow()["vector"]
    sample = _matrix(taken) if len(taken) else np.zeros((1, numbers))
    sample = sample[np.isfinite(sample).all(axis=1)]
    size = min(most, max(LEAST, n // BLOCKS))
    axes = _Axes.of(sample if len(sample) else np.zeros((1, numbers)), max(0, int(np.log2(max(1, min(8 * n / size, len(sample) / 8))))))

    # Of equal vectors only the k first keys can ever be among the k nearest.
    copies = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("key")
    useful = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k).drop("copy")
    placed = cut(useful.mapInArrow(axes.placed("key"), "key long, vector array<double>, leaf int"))
    held = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).orderBy("leaf").toArrow()
    sizes = np.zeros(len(axes.axis) + 1, np.int64)
    sizes[held["leaf"].to_numpy()] = held["rows"].to_numpy()
    if not sizes.sum():
        return spark.createDataFrame([], f"{_FOUND}, nth int")
    blocks = _Blocks.of(np.arange(len(sizes)), sizes, min(most, max(LEAST, int(sizes.sum()) // BLOCKS)))
    where = F.broadcast(spark.createDataFrame(pa.table({"leaf": blocks.cells.astype(np.int32), "first": blocks.first, "parts": np.maximum(1, blocks.parts)}), "leaf int, first long, parts long"))

    def in_blocks(df: DataFrame, key: str) -> DataFrame:
        return df.join(where, "leaf").select((F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))).alias("block"), key, "vector")

    side = in_blocks(placed, "key")
    boxes = side.mapInArrow(axes.boxes, "block long, low array<double>, high array<double>").select("block", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "box"))
    edges = boxes.groupBy("block", "axis").agg(F.min("box.low").alias("low"), F.max("box.high").alias("high")).orderBy("block", "axis").toArrow()
    low, high = (edges[c].to_numpy().reshape(-1, numbers) for c in ("low", "high"))
    ids = edges["block"].to_numpy()[::numbers]

    asked = queries.select(F.col("key").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    homes = in_blocks(cut(asked.mapInArrow(axes.placed("query"), "query long, vector array<double>, leaf int")), "query").withColumn("bound", F.lit(float("inf")))
    shape = "query long, vector array<double>, bound double, others array<long>, found array<struct<neighbour: long, distance: double>>"
    begun = cut(_in_chunks(side, homes, most).applyInArrow(_found_at_home(axes, k, ids, low, high), shape))
    first = begun.select("query", F.inline("found"))
    visits = begun.select(F.explode("others").alias("block"), "query", "vector", "bound")
    rest = _in_chunks(side, visits, most).applyInArrow(_found_elsewhere(axes, k), _FOUND)
    return best_of(first.unionByName(rest), k)


def neighbour_vote(base: DataFrame, queries: DataFrame, labels: DataFrame, k: int, same_table: bool = False) -> DataFrame:
    """The most common label among the ``k`` nearest, the smaller one in a tie, with its share.

    ``labels`` holds ``key`` and ``label``.  ``same_table`` leaves a row out of
    its own neighbours.
    """
    return vote(nearest_neighbours(base, queries, k + 1 if same_table else k), labels, k, same_table)


def vote(found: DataFrame, labels: DataFrame, k: int, same_table: bool = False) -> DataFrame:
    if same_table:
        others = found.filter(F.col("neighbour") != F.col("query")).drop("nth")
        found = best_of(others, k)
    voted = found.join(labels.withColumnRenamed("key", "neighbour"), "neighbour").groupBy("query", "label").agg(
        F.count(F.lit(1)).alias("votes")
    )
    return voted.groupBy("query").agg(
        F.max_by("label", F.struct(F.col("votes"), -F.col("label"))).alias("label"),
        (F.max("votes") / F.sum("votes")).alias("share"),
    ).withColumnRenamed("query", "key")
