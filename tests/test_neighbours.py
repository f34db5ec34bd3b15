"""Exact and hashed neighbours against all distances in numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priorsight.operators import hashed_neighbours, neighbours

SHAPE = "key long, vector array<double>"


def rows(vectors, first=0):
    return [(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]


def nearest(base, asked, k):
    out = {}
    for i, q in enumerate(asked):
        d = np.sqrt(((base - q) ** 2).sum(1))
        out[i] = [(int(j), float(d[j])) for j in np.lexsort((np.arange(len(base)), d))[:k]]
    return out


def clustered(rng, n, dim, clusters=12, scale=1.0):
    return (rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] * 4 + rng.standard_normal((n, dim))) * scale


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-6])
def test_exact_neighbours_in_small_blocks(spark, monkeypatch, scale):
    rng = np.random.default_rng(3)
    base = clustered(rng, 400, 12, scale=scale)
    base[50:90] = base[50]  # equal vectors
    asked = np.concatenate((base[:30], clustered(rng, 60, 12, scale=scale)))
    search = neighbours.search_cells
    monkeypatch.setattr(neighbours, "search_cells", lambda *a: search(*a, block_rows=25))
    got = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows(base), SHAPE), spark.createDataFrame(rows(asked), SHAPE), 6).collect():
        got.setdefault(r.query, []).append((r.nth, r.neighbour, r.distance))
    want = nearest(base, asked, 6)
    assert {q: [x[1] for x in sorted(v)] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(abs(x[2] - d) <= 1e-9 * scale for q, v in got.items() for x, (_, d) in zip(sorted(v), want[q]))


def test_only_visited_cells_are_searched(spark):
    placed = spark.createDataFrame([(i, [float(i)], i % 4) for i in range(40)], "key long, vector array<double>, cell long")
    visits = spark.createDataFrame([(100, [3.2], 1), (100, [3.2], 2), (101, [9.9], 9)], "query long, vector array<double>, cell long")
    got = sorted(map(tuple, neighbours.search_cells(placed, visits, 2, block_rows=3).groupBy("query", "neighbour").agg(F.min("distance")).collect()))
    assert {(q, n) for q, n, _ in got} >= {(100, 1), (100, 2), (100, 5), (100, 6)} and all(q == 100 and n % 4 in (1, 2) for q, n, _ in got)


def test_hashed_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(4)
    base = clustered(rng, 3000, 16)
    base[100:400] = base[100]  # a bucket far above the others
    df = spark.createDataFrame(rows(base), SHAPE).repartition(4).cache()
    tables = hashed_neighbours.fit(df, 5)
    found = hashed_neighbours.hashed_neighbours(df, df.filter("key % 10 = 0"), 5, tables).cache()
    want = nearest(base, base[::10], 5)
    exact = {(10 * q, round(d, 9)) for q, v in want.items() for _, d in v}
    # Compared by distance, since equal vectors are equally near.
    hits = sum((r.query, round(r.distance, 9)) in exact for r in found.collect())
    assert hits >= 0.95 * 5 * len(want)
    assert 1 <= tables.probes < 1 << tables.planes.shape[1]
    pairs = spark.createDataFrame([(10 * q, j) for q, v in want.items() for j, _ in v], "query long, neighbour long")
    counted = hashed_neighbours.recall(found, pairs)
    assert counted.agg(F.sum("n_exact")).first()[0] == 5 * len(want) and counted.filter("n_found > n_exact").isEmpty()


def test_hashed_neighbours_of_little(spark):
    none = spark.createDataFrame([], SHAPE)
    one = spark.createDataFrame([(1, [1.0, 2.0])], SHAPE)
    assert hashed_neighbours.hashed_neighbours(one, one, 3).select("query", "neighbour").collect() == [(1, 1)]
    assert hashed_neighbours.hashed_neighbours(none, none, 3).count() == 0


def test_a_query_goes_to_a_block_and_not_to_each_of_its_cells(spark, monkeypatch):
    placed = spark.createDataFrame([(i, [float(i)], i % 50) for i in range(400)], "key long, vector array<double>, cell long")
    visits = spark.createDataFrame([(q, [float(q)], c) for q in range(60) for c in range(50)], "query long, vector array<double>, cell long")
    asked = visits.groupBy("query", "vector").agg(F.collect_list("cell").alias("cells"))

    def sent(k, distinct):
        return lambda base, asked: pa.table({"query": pa.array([asked.num_rows]), "neighbour": pa.array([base.num_rows]), "distance": pa.array([0.0])})

    with monkeypatch.context() as patch:
        patch.setattr(neighbours, "_search_tile", sent)
        tiles = neighbours.search_cells(placed, asked, 3, 100).collect()
    # Four blocks of a hundred rows, not fifty cells; one chunk of queries.
    assert len(tiles) == 4 and sum(t.query for t in tiles) == 4 * 60 and sum(t.neighbour for t in tiles) == 400

    rows = lambda df: sorted((r.query, r.nth, r.neighbour, r.distance) for r in neighbours.best_of(df, 3).collect())
    got = rows(neighbours.search_cells(placed, asked, 3, 100))
    assert [(q, j) for q, _, j, _ in got] == [(q, int(j)) for q in range(60) for j in np.lexsort((np.arange(400), abs(np.arange(400) - q)))[:3]]
    assert rows(neighbours.search_cells(placed, asked.withColumn("bound", F.lit(1.0)), 3, 100)) == [r for r in got if r[3] <= 1]
    monkeypatch.setattr(neighbours, "SENT_CELLS", 10)
    assert rows(neighbours.search_cells(placed, asked, 3, 7)) == got


def test_cells_larger_than_a_block_are_split(spark):
    rng = np.random.default_rng(9)
    base, asked = rng.standard_normal((300, 4)), rng.standard_normal((40, 4))
    placed = spark.createDataFrame([(i, v.tolist(), -5 if i < 200 else i % 3) for i, v in enumerate(base)], "key long, vector array<double>, cell long")
    visits = spark.createDataFrame([(i, v.tolist(), [2, -5, 7, 0]) for i, v in enumerate(asked)], "query long, vector array<double>, cells array<long>")
    open_rows = np.array([i for i in range(300) if i < 200 or i % 3 in (0, 2)])
    want = {q: [int(open_rows[j]) for j, _ in v] for q, v in nearest(base[open_rows], asked, 5).items()}
    got = {}
    for r in neighbours.best_of(neighbours.search_cells(placed, visits, 5, 30), 5).collect():
        got.setdefault(r.query, []).append((r.nth, r.neighbour))
    assert {q: [j for _, j in sorted(v)] for q, v in got.items()} == want


def test_a_row_in_several_opened_cells_is_one_neighbour(spark):
    placed = spark.createDataFrame([(i, [float(i)], t) for i in range(30) for t in range(12)], "key long, vector array<double>, cell long")
    asked = spark.createDataFrame([(q, [float(q)], list(range(12))) for q in range(5)], "query long, vector array<double>, cells array<long>")
    found = neighbours.best_of(neighbours.search_cells(placed, asked, 4, distinct=True), 4).collect()
    got = {q: {r.neighbour for r in found if r.query == q} for q in range(5)}
    assert got == {0: {0, 1, 2, 3}, 1: {0, 1, 2, 3}, 2: {0, 1, 2, 3}, 3: {1, 2, 3, 4}, 4: {2, 3, 4, 5}}


def tables(base, asked, bound=np.inf):
    lists = lambda m: pa.array([list(map(float, v)) for v in m], pa.list_(pa.float64()))
    return pa.table({"key": np.arange(len(base)), "vector": lists(base)}), pa.table({"query": np.arange(len(asked)), "vector": lists(asked), "bound": np.full(len(asked), float(bound))})


@pytest.mark.parametrize("kind", ["clustered", "whole numbers", "far off", "one axis", "tiny"])
@pytest.mark.parametrize("leaf", [3, 40])
def test_leaves_of_a_block_against_all_distances(monkeypatch, kind, leaf):
    rng = np.random.default_rng(5)
    base = {
        "clustered": lambda: clustered(rng, 500, 9), "whole numbers": lambda: rng.integers(0, 3, (500, 4)).astype(float), "far off": lambda: clustered(rng, 500, 6) + 1e7,
        "one axis": lambda: np.column_stack((rng.standard_normal(500), np.zeros((500, 3)))), "tiny": lambda: clustered(rng, 500, 5, scale=1e-9),
    }[kind]()
    asked = np.concatenate((base[:40], base[40:80] + rng.standard_normal((40, base.shape[1])) * base.std()))
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    axes = neighbours._Axes.of(base[::5], 3)
    for k in (1, 5, 600):
        got, want = neighbours._nearest_in(axes, k, *tables(base, asked)), nearest(base, asked, k)
        found = np.isfinite(got.distance)
        assert {q: list(zip(got.key[q][found[q]].tolist(), got.distance[q][found[q]].tolist())) for q in want} == want
    bound = np.median([v[2][1] for v in want.values()])
    near = neighbours._nearest_in(axes, 5, *tables(base, asked, bound))
    for q, v in want.items():
        sure = [x for x in v[:5] if x[1] <= bound]
        assert list(zip(near.key[q].tolist(), near.distance[q].tolist()))[: len(sure)] == sure


def test_a_query_goes_only_to_blocks_that_can_hold_something_nearer(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 12))[rng.integers(0, 40, 4000)] * 9 + rng.standard_normal((4000, 12))
    asked = base[rng.choice(4000, 300, replace=False)] + rng.standard_normal((300, 12)) / 3
    frames = spark.createDataFrame(rows(base), SHAPE).repartition(5).cache(), spark.createDataFrame(rows(asked), SHAPE).repartition(3).cache()
    monkeypatch.setattr(neighbours, "LEAST", 50)

    def visits(axes, k):
        return lambda base, asked: pa.table({"query": -1 - base["block"].to_numpy()[:1] * 1000 - base["chunk"].to_numpy()[:1], "neighbour": pa.array([asked.num_rows]), "distance": pa.array([0.0])})

    with monkeypatch.context() as patch:
        patch.setattr(neighbours, "_found_elsewhere", visits)
        gone = neighbours.nearest_neighbours(*frames, 5).filter("query < 0").agg(F.sum("neighbour")).first()[0]
    # Eight blocks; each query goes to its own and to less than half of the others.
    assert 0 < gone < 300 * 7 / 2
    got = {}
    for r in neighbours.nearest_neighbours(*frames, 5).collect():
        got.setdefault(r.query, []).append((r.nth, r.neighbour, r.distance))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == nearest(base, asked, 5)


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, [float(i % 4), 1.0]) for i in range(40)] + [(50, [nan, 1.0]), (51, [inf, 0.0]), (3, [3.0, 1.0]), (60, [-0.0, 1.0])]
    asked = [(1, [0.0, 1.0]), (2, [nan, 0.0]), (3, [-inf, 1.0]), (1, [0.0, 1.0])]
    got = neighbours.nearest_neighbours(spark.createDataFrame(base, SHAPE), spark.createDataFrame(asked, SHAPE), 3).collect()
    # A key that is asked twice finds each of its neighbours twice.
    assert sorted((r.query, r.nth, r.neighbour, r.distance) for r in got) == [(1, 1, 0, 0.0), (1, 2, 0, 0.0), (1, 3, 4, 0.0)]
    for wrong in ([(1, [0.0]), (2, None)], [(1, [0.0]), (2, [1.0, 2.0])], [(1, [0.0, 1.0]), (2, None), (3, [1.0, 2.0]), (4, None)]):
        with pytest.raises(Exception, match="a vector is null, or vectors differ in length"):
            neighbours.nearest_neighbours(spark.createDataFrame(wrong, SHAPE), spark.createDataFrame([(1, [0.0])], SHAPE), 2).collect()
    keys = spark.createDataFrame([(None, [0.5]), (2**60 + 1, [2.0])], SHAPE)
    assert [r.neighbour for r in neighbours.nearest_neighbours(keys, keys.filter("key > 0"), 2).orderBy("nth").collect()] == [2**60 + 1, -(2**63)]
    none, one = spark.createDataFrame([], SHAPE), spark.createDataFrame([(7, [1.0])], SHAPE)
    for a, b in ((none, one), (one, none), (none, none), (spark.createDataFrame([(8, [nan])], SHAPE), one)):
        assert neighbours.nearest_neighbours(a, b, 2).count() == 0
    assert [tuple(r) for r in neighbours.nearest_neighbours(one, one, 2).select("query", "neighbour", "distance", "nth").collect()] == [(7, 7, 0.0, 1)]
