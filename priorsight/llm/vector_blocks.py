"""Vectors packed into blocks, and the grid of query blocks by candidate blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorsight.plans.lineage import cut

#: Components of a block at most, whatever its rows: 64 MB as doubles.
COMPONENTS = 1 << 23


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, and every component there and finite."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def packed_blocks(vectors: DataFrame, rows: int, pack: Callable[[np.ndarray], dict[str, bytes]], fields: tuple[str, ...]) -> DataFrame:
    """``dim, block, ids`` and the binary ``fields`` that ``pack`` makes of a block's matrix.

    Rows (``vec_id, embedding``) are dealt to blocks of about ``rows`` by a hash of the row, of fewer where vectors are so long that a block
    would pass ``COMPONENTS``; only vectors of one length share a block.
    """
    sized = vectors.select("vec_id", "embedding", F.size("embedding").alias("dim"))
    most = F.least(F.lit(rows), F.greatest(F.floor(F.lit(COMPONENTS) / F.col("dim")), F.lit(1)))
    counts = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / most).alias("blocks"))
    dealt = sized.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        order = np.argsort(part["vec_id"].to_numpy(), kind="stable")
        part = part.take(pa.array(order)).combine_chunks()
        made = pack(matrix(part["embedding"].chunk(0)))
        columns = {"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([part["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary())}
        return pa.table(columns | {f: pa.array([made[f]], pa.binary()) for f in fields})

    schema = "dim int, block long, ids binary, " + ", ".join(f"{f} binary" for f in fields)
    return cut(dealt.groupBy("dim", "block").applyInArrow(run, schema))


def tiles(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for every query block and candidate block of one length: ``q`` and ``c``, structs of their columns.

    Every block of one side must meet every block of the other; both are repeated by number and met by the pair, so tiles
    spread over all tasks, and a block moves once a tile.
    """
    of_queries, of_candidates = (side.groupBy("dim").agg(F.max("block").alias("last")) for side in (queries, candidates))

    def repeated(side: DataFrame, others: DataFrame, name: str, own: str, other: str) -> DataFrame:
        numbers = F.sequence(F.lit(0).cast("long"), F.col("last"))
        return side.join(others, "dim").select("dim", F.col("block").alias(own), F.explode(numbers).alias(other), F.struct(*[c for c in side.columns if c != "dim"]).alias(name))

    return repeated(queries, of_candidates, "q", "qb", "cb").join(repeated(candidates, of_queries, "c", "cb", "qb"), ["dim", "qb", "cb"]).select("dim", "q", "c")


def each_tile(batches: Iterator[pa.RecordBatch], search: Callable[[dict, dict, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``search(q, c, dim)`` of every tile gives query ids, candidate ids and scores."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            query, vec, score = search(row["q"], row["c"], row["dim"])
            yield pa.record_batch({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score)})


def best(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query, ties to the smaller id.

    A tile gives at most ``k`` rows of a query; Spark keeps ``k`` a task before the rows meet.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
