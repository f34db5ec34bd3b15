"""Approximate nearest neighbours by a block matrix join on int8 tiles.

Vectors are quantised to int8 with one scale each.  A tile multiplies a query block by a
candidate block in whole numbers; what quantisation took away is bounded by its norm, so every
product comes with an interval that holds the true one.  Candidates whose upper end
reaches a query's k-th lower end survive, are recomputed from the original vectors in double precision and merged
by heaps.  The bounds hold, so nothing is lost: recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.llm.vector_blocks import best, each_tile, packed_blocks, tiles, usable

NEIGHBOURS, EVERY = 20, 20
#: Rows of a candidate block and of a query block, and query rows multiplied at a time.  Every block moves once for each block of the
#: other side, so tiles of a given size move least when they are square.
CANDIDATES, QUERIES, STRIP = 8_192, 8_192, 64
FIELDS = ("codes", "scales", "errors", "norms", "values")


def quantised(x: np.ndarray) -> dict[str, bytes]:
    """int8 codes, scale, norm of what they miss, and norm, of each row; and the rows themselves as they were."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    # A hair wider than computed, for the rounding of the norms themselves.
    missed = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-300
    return {"codes": codes.tobytes(), "scales": scale.tobytes(), "errors": missed.tobytes(), "norms": (np.linalg.norm(x, axis=1) * (1 + 1e-9)).tobytes(), "values": x.tobytes()}


def _search(k: int):
    def run(q: dict, c: dict, dim: int):
        side = lambda s: (
            np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["codes"], np.int8).reshape(-1, dim).astype(np.float32 if dim < 1000 else np.float64),
            np.frombuffer(s["scales"]), np.frombuffer(s["errors"]), np.frombuffer(s["norms"]), np.frombuffer(s["values"]).reshape(-1, dim),
        )
        q_ids, q_codes, q_scale, q_miss, q_norm, q_values = side(q)
        c_ids, c_codes, c_scale, c_miss, c_norm, c_values = side(c)
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(q_ids), STRIP):
            rows = slice(at, at + STRIP)
            # Sums of int8 products are whole numbers that floats of this width hold exactly.
            about = (q_codes[rows] @ c_codes.T).astype(np.float64) * q_scale[rows, None] * c_scale
            slack = (q_norm[rows, None] + q_miss[rows, None]) * c_miss + q_miss[rows, None] * c_norm
            slack += 1e-12 * q_norm[rows, None] * c_norm
            for i, name in enumerate(q_ids[rows].tolist()):
                others = c_ids != name
                low = np.where(others, about[i] - slack[i], -np.inf)
                bound = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                alive = np.flatnonzero((about[i] + slack[i] >= bound) & others)
                # Running sums add in the order of the components, so that equal vectors score alike anywhere.
                exact = np.cumsum(c_values[alive] * q_values[at + i], axis=1)[:, -1]
                near = heapq.nsmallest(k, zip((-exact).tolist(), c_ids[alive].tolist()))
                out += [(name, vec, -s) for s, vec in near]
        found = np.array(out, dtype=[("q", "i8"), ("c", "i8"), ("s", "f8")])
        return found["q"], found["c"], found["s"]

    return lambda batches: each_tile(batches, run)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the ``k`` rows of ``vectors`` with the largest inner product (both ``vec_id, embedding``).

    A query's own id is no candidate; fewer candidates give fewer rows; ties go to the smaller id.  Null ids, vectors that are null, empty or
    zero, and those with null or non-finite components take no part; vectors of other lengths are not compared.
    Repeated rows count once; an empty side gives no rows.
    """
    clean = lambda df: df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable() & F.exists("embedding", lambda x: x != 0)).distinct()
    q = packed_blocks(clean(queries), QUERIES, quantised, FIELDS)
    c = packed_blocks(clean(vectors), CANDIDATES, quantised, FIELDS)
    found = tiles(q, c).mapInArrow(_search(k), "query_id long, vec_id long, score double")
    return best(found, k)


@query(
    "op1_nearest_blocks",
    f"""with v as (select distinct vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q, v c where q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, rank::integer as rank, vec_id, score from r where rank <= {NEIGHBOURS}""",
)
def op1_nearest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf, "embeddings")
    return neighbours(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
