"""Exact top-k search by elimination over a pivot table.

Components are turned into whole numbers, floor(256 x).  Every vector's distances to many pivots are
computed once.  By the triangle inequality, the largest difference of two vectors' pivot distances is a
lower bound on their own distance, and with their norms it bounds their inner product from above.  A query
takes the candidates of a block in the order of this bound and stops as soon as the bound falls below
its k-th score; scores are whole numbers, so the answer is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorsight.llm.registry import query, table
from priorsight.llm.vector_blocks import best, each_tile, matrix, packed_blocks, tiles, usable

NEIGHBOURS, EVERY = 5, 50
#: Pivots of each vector length, chosen far apart from about so many sampled rows.
PIVOTS, SAMPLE = 48, 4_096
CANDIDATES, QUERIES, STEP = 16_384, 4_096, 256
FIELDS = ("values", "squares", "table")
#: Products whose sums stay below this are exact in doubles; others are summed as Python's whole numbers.
EXACT = 1 << 53


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows that are far from each other: each next one is the farthest from those before."""
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _packed(pivots: dict[int, np.ndarray]):
    def pack(x: np.ndarray) -> dict[str, bytes]:
        p = pivots.get(x.shape[1], np.empty((0, x.shape[1])))
        squares = (x**2).sum(axis=1)
        apart = squares[:, None] + (p**2).sum(axis=1) - 2 * (x @ p.T)  # whole numbers, exact in doubles
        return {"values": x.tobytes(), "squares": squares.tobytes(), "table": np.sqrt(np.maximum(apart, 0)).tobytes()}

    return pack


def _products(candidates: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of a long, its ends."""
    largest = float(np.abs(candidates).max(initial=0)) * float(np.abs(one).max()) * len(one)
    if largest < EXACT:
        return (candidates @ one).astype(np.int64)
    whole = [int(x) for x in one.tolist()]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in candidates.tolist())
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums], np.int64)


def _search(k: int):
    def run(q: dict, c: dict, dim: int):
        side = lambda s: (np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["values"]).reshape(-1, dim), np.frombuffer(s["squares"]), s["table"])
        q_ids, q_values, q_squares, q_table = side(q)
        c_ids, c_values, c_squares, c_table = side(c)
        q_table, c_table = np.frombuffer(q_table).reshape(len(q_ids), -1), np.ascontiguousarray(np.frombuffer(c_table).reshape(len(c_ids), -1).T)
        out: list[np.ndarray] = []
        for i, name in enumerate(q_ids.tolist()):
            apart = np.zeros(len(c_ids))
            for p in range(len(c_table)):
                np.maximum(apart, np.abs(c_table[p] - q_table[i, p]), out=apart)
            # A little less than computed, for the rounding of squares and roots.
            apart = np.maximum(apart - 1e-7 * (np.sqrt(q_squares[i]) + np.sqrt(c_squares)), 0)
            bound = (q_squares[i] + c_squares - apart**2) / 2 + 1e-12 * (q_squares[i] + c_squares)
            bound[c_ids == name] = -np.inf
            order, at, ids, scores = None, 0, np.empty(0, np.int64), np.empty(0, np.int64)
            while at < len(bound):
                if order is None:  # the first step needs only the head of the order
                    head = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
                    take = head[np.argsort(-bound[head])]
                else:
                    take = order[at : at + STEP]
                take = take[bound[take] > -np.inf]
                if not len(take) or (len(scores) >= k and bound[take[0]] < scores[k - 1]):
                    break
                ids, scores = np.concatenate((ids, c_ids[take])), np.concatenate((scores, _products(c_values[take], q_values[i])))
                top = np.lexsort((ids, ~scores))[:k]  # ~ turns the order round without overflow
                ids, scores = ids[top], scores[top]
                at += STEP
                if order is None and at < len(bound):
                    # The rest, unless the head has settled it: what may still reach the k-th score.
                    rest = np.ones(len(bound), bool)
                    rest[head] = False
                    if len(scores) >= k:
                        rest &= bound >= scores[k - 1]
                    rest = np.flatnonzero(rest)
                    order = np.concatenate((head, rest[np.argsort(-bound[rest])]))
            out.append(np.rec.fromarrays([np.full(len(ids), name), ids, scores], names="q,c,s"))
        found = np.concatenate(out)
        return found["q"], found["c"], found["s"]

    return lambda batches: each_tile(batches, run)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` with components floor(256 x); rows that take part in no search are left out."""
    clean = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable())
    return clean.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Of each vector length, pivots from about ``sample`` rows drawn by hashing ids; these rows reach the driver."""
    sized = vectors.withColumn("dim", F.size("embedding"))
    counts = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    drawn = sized.join(counts, "dim").filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) * F.col("n") < sample * (1 << 20))
    by: dict[int, list] = {}
    for row in drawn.select("dim", "vec_id", "embedding").collect():
        by.setdefault(row.dim, []).append((row.vec_id, row.embedding))
    return {dim: far_apart(np.array([v for _, v in sorted(rows)]), count) for dim, rows in by.items()}


def top_products(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the ``k`` rows of ``vectors`` with the highest whole-number inner product (both ``vec_id, embedding``).

    A query's own id is no candidate; fewer candidates give fewer rows; ties go to the smaller id.  Null ids, vectors that are null or
    empty, and those with null or non-finite components take no part, zero vectors do; vectors of other lengths are not
    compared.  Repeated rows count once; an empty side gives no rows.  Scores beyond the range of a long are its ends.
    """
    candidates = whole_numbers(vectors).distinct()
    pack = _packed(choose_pivots(candidates, pivots))
    q = packed_blocks(whole_numbers(queries).distinct(), QUERIES, pack, FIELDS)
    c = packed_blocks(candidates, CANDIDATES, pack, FIELDS)
    found = tiles(q, c).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    return best(found, k)


@query(
    "op7_pivot_search",
    f"""with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(list_transform(q.e, lambda x: x::double), list_transform(c.e, lambda x: x::double))::bigint as score
    from v q, v c where q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, rank::integer as rank, vec_id, score from r where rank <= {NEIGHBOURS}""",
)
def op7_pivot_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five highest products of every vector whose id is divisible by 50."""
    vectors = table(spark, sf, "embeddings")
    return top_products(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
