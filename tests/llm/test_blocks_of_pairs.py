"""Pairs confirmed in blocks, tables of loops that go, and statistics of very long runs."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorsight.llm import near_dedup, quality
from priorsight.llm.components import components, extended


def packed(values):
    s = np.array(sorted(values), np.uint64)
    return (s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (s >> np.uint64(32)).astype("u1").tobytes()


@pytest.mark.parametrize("many, block", [(1, 200), (4, 1000), (10**6, 1000)])
def test_confirmation_by_blocks_is_that_by_pairs(spark, monkeypatch, many, block):
    rng = random.Random(9)
    base = [rng.randrange(2**40) for _ in range(60)]
    known = {i: {x if rng.random() > (i % 7) / 12 else rng.randrange(2**40) for x in base} for i in range(40)}
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.9 if a < 20 else 0.1)]
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets = spark.createDataFrame([(i, packed(s)) for i, s in known.items()], "cls long, shingles binary")
    for percent in (50, 80):
        got = near_dedup._confirm(spark.createDataFrame(pairs, "a long, b long"), sets, percent, many).collect()
        want = [(a, b) for a, b in pairs if 100 * len(known[a] & known[b]) >= percent * len(known[a] | known[b])]
        assert sorted((r.a, r.b) for r in got) == want and 0 < len(want) < len(pairs)
    assert near_dedup._confirm(spark.createDataFrame([], "a long, b long"), sets, 80, many).count() == 0


def sketched(known):
    """Rows ``cls, n, bits`` as ``near_duplicates`` has them, and ``cls, shingles``, of sets of hashes."""
    light = []
    for c, values in known.items():
        nibbles = (near_dedup.minwise(np.array(sorted(values), np.uint64)) & 15).astype(np.uint64).reshape(-1, 16)
        bits = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)
        light.append((c, len(values), bits.tolist()))
    return light, [(c, packed([x >> 24 for x in values])) for c, values in known.items()]


@pytest.mark.parametrize("tile, tiles, size", [(8, 2, 1 << 22), (1000, 16, 1 << 22), (1000, 16, 900), (1, 1000, 1)])
def test_links_between_tiles_join_what_all_pairs_join(spark, monkeypatch, tile, tiles, size):
    """Two nodes that share members; some members are one component before, enough of them for tiles of their own."""
    rng = random.Random(21)
    base = [rng.randrange(2**64) for _ in range(80)]
    known = {i: {x if rng.random() > (i % 9) / 30 else rng.randrange(2**64) for x in base} for i in range(70)}
    known |= {i: {rng.randrange(2**64) for _ in range(1 + i % 5)} for i in range(70, 80)} | {80: {7 << 24}, 81: {7 << 24}}
    light, sets = sketched(known)
    members = [(n, c) for n in (1, 2) for c in known if n == 1 or c % 2 or c == 80] + [(3, 5), (3, 6)]
    before = [(c, 0) for c in range(0, 70, 9)]
    for name, value in (("TILE", tile), ("TILES", tiles), ("TILE_BYTES", size)):
        monkeypatch.setattr(near_dedup, name, value)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    joined = frame(before, "id long, root long")
    got = near_dedup._links_between_tiles(frame(members, "node long, cls long"), joined, frame(light, "cls long, n long, bits array<long>"), frame(sets, "cls long, shingles binary"), 80).collect()
    alike = lambda a, b: 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b])
    assert got and all(alike(r.a, r.b) for r in got)

    def parts(links):
        root = {c: dict(before).get(c, c) for c in known}
        for a, b in links:
            x, y = root[a], root[b]
            root = {c: min(x, y) if r in (x, y) else r for c, r in root.items()}
        return root

    every = [(a, b) for n in (1, 2, 3) for m, a in members for k, b in members if m == k == n and a < b and alike(a, b)]
    assert len(got) <= len(every) and (size < 1000 or len(got) < len(every) / 2)
    assert parts([(r.a, r.b) for r in got]) == parts(every)


def test_pairs_of_a_large_group_are_not_listed(spark, monkeypatch):
    """Texts with similarities to each other just below the threshold, more than a node holds: their pairs stay in their tiles."""
    rng, listed, confirm = random.Random(17), [], near_dedup._confirm
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]

    def counted(pairs, *more):
        listed.append(pairs.distinct().count())
        return confirm(pairs, *more)

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    texts = {}
    for i in range(600):
        t = list(base)
        for at in rng.sample(range(200), 4 if i % 50 else 1):
            t[at] = f"x{i}y{at}"
        texts[i] = " ".join(t)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 4).collect()
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in texts.items())}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {c: min(x, y) if r in (x, y) else r for c, r in root.items()}
    assert {r.doc_id: r.component_id for r in got} == root
    assert sum(listed) < 20 * len(texts)


def test_loops_leave_no_tables(spark):
    links = [(i, i + 1) for i in range(0, 90) if i % 10 != 9] + [(500, 3), (500, 77)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[9] == 0 and got[500] == got[79] == 0 and got[89] == 80
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("steps-")]


def test_components_are_extended_as_if_from_nothing(spark):
    rng = random.Random(3)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(60)]
    more = [(rng.randrange(200), rng.randrange(200)) for _ in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = extended(components(frame(links)), frame(more)).collect()
    want = components(frame(links + more)).collect()
    assert sorted((r.id, r.root) for r in got) == sorted((r.id, r.root) for r in want)
    once = components(frame(links))
    assert extended(once, frame([])).count() == once.count()


RUNS = "=a1 \n.|!A-é日_#/"


def test_statistics_take_linear_time_on_long_runs(spark):
    def seconds(n):
        texts = [c * n + "z" for c in RUNS] + ["=-" * (n // 2), "= " * (n // 2), "ab " * (n // 3)]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8).cache()
        rows.count()
        began = time.time()
        quality.with_statistics(rows, ["doc_id"]).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1000)
    assert seconds(1_000_000) < 60


def test_symbol_runs_are_counted_as_before(spark):
    texts = ["== x", "a== b", "==a ==", "= x", "=| \n!!", "#$%a%$#", "+++", "x", "", "a+ ++ +a ++", "<<>> =="]
    old = r"[#$%&*@^~<>=+|!]{2,}(?=\s|$)"
    new = r"(?<![#$%&*@^~<>=+|!])[#$%&*@^~<>=+|!]{2,}+(?=\s|$)"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(F.regexp_count("t", F.lit(old)) == F.regexp_count("t", F.lit(new))).distinct().collect() == [(True,)]
