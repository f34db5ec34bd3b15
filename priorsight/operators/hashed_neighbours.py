"""Approximate nearest neighbours by random-projection hash tables with multi-probe; candidates are ranked by exact distance.

A table cuts space by a few random directions, each at the median of a sample, so buckets are about equally full.  A query
looks into its own bucket of every table and into those across the planes that it is nearest to.  How many buckets that
takes is measured on a bounded sample of rows, whose neighbours are farther than those in the whole table, so the whole
table is not searched worse than the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorsight.functions.scalars import hashed_unit
from priorsight.operators.neighbours import best_of, search_cells, stacked, vote
from priorsight.plans.lineage import cut

TABLES, SAMPLE, ASKED = 12, 4_096, 256
#: Rows that a bucket should hold.
BUCKET = 128
#: Planes nearest to a query among which the probed buckets differ from its own.
FLIPPED = 10


@dataclass
class Tables:
    """``planes`` (tables, bits, numbers of a vector), the place of each along its direction, and how many buckets of a table a query opens."""

    planes: np.ndarray
    places: np.ndarray
    probes: int

    def sides(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distance of every vector to every plane."""
        return np.einsum("nd,tbd->tnb", vectors, self.planes) - self.places[:, None, :]

    def codes(self, sides: np.ndarray) -> np.ndarray:
        return (sides > 0) @ (1 << np.arange(sides.shape[-1], dtype=np.int64))

    def probed(self, sides: np.ndarray, probes: int) -> np.ndarray:
        """Codes of the buckets to open, (tables, vectors, probes): those least far across the planes first, the own one foremost."""
        bits = sides.shape[-1]
        near = np.argsort(np.abs(sides), axis=-1)[..., : min(bits, FLIPPED)]
        flips = np.arange(1 << near.shape[-1])
        chosen = (flips[:, None] >> np.arange(near.shape[-1])) & 1
        cost = np.square(np.take_along_axis(sides, near, -1)) @ chosen.T
        order = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
        masks = (np.int64(1) << near) @ chosen.T
        return self.codes(sides)[..., None] ^ np.take_along_axis(masks, order, -1)


def fit(base: DataFrame, k: int, recall: float = 0.97, tables: int = TABLES, seed: int = 7) -> Tables:
    """Planes for ``base`` (``key``, ``vector``), and as many probes as find the share ``recall`` of neighbours in a sample of ``SAMPLE`` rows."""
    n = base.count()
    drawn = base.orderBy(hashed_unit(F.col("key"), "tables"), "key").limit(SAMPLE).select(F.col("vector").cast("array<double>").alias("vector")).toPandas()
    if not len(drawn):
        return Tables(np.zeros((1, 1, 1)), np.zeros((1, 1)), 1)
    sample = stacked(drawn["vector"])
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / BUCKET)), 1, 40))
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits, sample.shape[1]))
    made = Tables(planes, np.zeros((tables, bits)), 1)
    made.places = np.median(made.sides(sample), axis=1)
    asked = sample[:ASKED]
    apart = (asked**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * asked @ sample.T
    apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    found = np.argsort(apart, axis=1)[:, : min(k, len(sample) - 1)]
    if not found.size:
        return made
    sides = made.sides(sample)
    opened, own = made.probed(sides[:, : len(asked)], 1 << min(bits, FLIPPED)), made.codes(sides)
    # The place in the order of probes at which the best table opens the neighbour's bucket.
    hit = opened[:, :, None, :] == own[:, found][..., None]
    place = np.where(hit.any(-1), hit.argmax(-1), hit.shape[-1]).min(axis=0)
    made.probes = int(min(np.quantile(place, recall, method="higher") + 1, hit.shape[-1]))
    return made


def hashed_neighbours(base: DataFrame, queries: DataFrame, k: int, tables: Tables | None = None) -> DataFrame:
    """``query, neighbour, distance, nth`` of the ``k`` nearest that the opened buckets hold; every distance is exact.

    Both sides have ``key`` (long) and ``vector``.  Buckets of any size are split, and only buckets that a query opens are read.
    """
    tables = tables or fit(base, k)
    width = tables.planes.shape[1]
    number = (np.arange(len(tables.planes), dtype=np.int64) << width)[:, None]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = tables.codes(tables.sides(stacked(batch["vector"]))) + number
                yield batch.assign(cells=list(codes.T))

    def open_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                codes = tables.probed(tables.sides(stacked(some["vector"])), tables.probes) + number[..., None]
                # In order, as the cells are dealt to blocks.
                yield some.assign(cells=list(np.sort(np.moveaxis(codes, 1, 0).reshape(len(some), -1), axis=1)))

    vector = F.col("vector").cast("array<double>").alias("vector")
    placed = base.select("key", vector).mapInPandas(place, "key long, vector array<double>, cells array<long>")
    asked = queries.select(F.col("key").alias("query"), vector).mapInPandas(open_cells, "query long, vector array<double>, cells array<long>")
    near = search_cells(
        cut(placed.select("key", "vector", F.explode("cells").alias("cell"))), asked, k, distinct=True
    )
    # A pair found in several tables has one distance.
    return best_of(near.groupBy("query", "neighbour").agg(F.min("distance").alias("distance")), k)


def hashed_vote(base: DataFrame, queries: DataFrame, labels: DataFrame, k: int, same_table: bool = False, tables: Tables | None = None) -> DataFrame:
    """As ``neighbours.neighbour_vote``, among the neighbours that hashing finds."""
    return vote(hashed_neighbours(base, queries, k + 1 if same_table else k, tables), labels, k, same_table)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query, n_exact, n_found``: how many of a query's exact neighbours (``query``, ``neighbour``) were found."""
    hits = exact.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
