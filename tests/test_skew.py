"""The windowed operators against brute force, on a log where one key and one instant are crowded.

Each case runs with whole keys as cells, with fine cells, and with cells so
small that single instants have to be split.
"""

import math
import random
from statistics import mean, median, pstdev

import pytest
from pyspark.sql import functions as F

from priorsight.operators import categories, encoding, families, history
from priorsight.plans import timegrid
from priorsight.plans.windows import totals_before, window_totals

DAY = timegrid.DAY_US
DAYS = (7, 2, 1)
START = 1_700_000_000_000_000


def make_log(seed=5):
    r = random.Random(seed)
    logins, trades = [], []

    def when():
        t = r.random()
        if t < 0.25:
            return START + 9 * DAY + 250_000_000  # one crowded instant
        if t < 0.6:
            return START + r.randrange(12) * DAY  # ties, and gaps of exactly whole days
        return START + r.randrange(12 * DAY)

    def who():
        t = r.random()
        return None if t < 0.05 else "hot" if t < 0.45 else f"u{r.randrange(6)}"

    for i in range(260):
        device = None if r.random() < 0.1 else r.randrange(5)
        logins.append((i, who(), when(), r.choice([-2, -1, 1, 1, 31]), r.randrange(4000), device))
    for i in range(120):
        trades.append((1000 + i, who(), when(), r.choice([0, 1, None])))
    return logins, trades


@pytest.fixture(scope="module", params=["keys", "cells", "instants"])
def log(request, spark):
    logins, trades = make_log()
    old = timegrid.CELL_ROWS
    timegrid.CELL_ROWS = {"keys": 10**6, "cells": 75, "instants": 3}[request.param]
    frames = (
        spark.createDataFrame(logins, "log_id long, id string, us long, result int, timelong long, device int"),
        spark.createDataFrame(trades, "rowkey long, id string, us long, is_risk int"),
    )
    widths = timegrid.measure_widths(list(frames), ["id"])
    expected = {"keys": widths == (), "cells": len(widths) > 0 and widths[0] > 0, "instants": widths[:1] == (0,)}
    assert expected[request.param], widths
    yield (*frames, logins, trades)
    timegrid.CELL_ROWS = old


def before(logins, trade, d=None, key=1, value=None):
    value = trade[1] if value is None else value
    return [
        row for row in logins
        if value is not None and row[key] == value and row[2] < trade[2] and (d is None or trade[2] - row[2] < d * DAY)
    ]


def test_window_totals(log):
    L, T, logins, trades = log
    got = window_totals(L, T, ["id"], {"n": F.lit(1).cast("long"), "ms": F.col("timelong")}, DAYS).collect()
    assert len(got) == len(trades)
    by = {r["rowkey"]: r for r in got}
    for t in trades:
        for d in DAYS:
            rows = before(logins, t, d)
            assert (by[t[0]][f"n_{d}"], by[t[0]][f"ms_{d}"]) == (len(rows), sum(r[4] for r in rows))


def test_sweep_equals_difference(log):
    L, T, _, _ = log
    measures = {"n": F.lit(1).cast("long")}
    a = window_totals(L, T, ["id"], measures, DAYS).select("rowkey", "n_7", "n_2", "n_1").collect()
    b = window_totals(L, T, ["id"], measures, DAYS, start="us").select("rowkey", "n_7", "n_2", "n_1").collect()
    assert sorted(a) == sorted(b)


def test_totals_before(log):
    L, T, logins, trades = log
    got = {r["rowkey"]: r["n"] for r in totals_before(L, T, ["id"], {"n": F.lit(1).cast("long")}).collect()}
    assert got == {t[0]: len(before(logins, t)) for t in trades}


def test_last_three(log):
    L, T, logins, trades = log
    got = {r["rowkey"]: r for r in history.link_last_events(L, T, ["log_id", "result"], 3).collect()}
    assert len(got) == len(trades)
    for t in trades:
        want = [r[0] for r in sorted(before(logins, t), key=lambda r: (r[2], r[0]), reverse=True)[:3]]
        have = [got[t[0]][f"last_{i}"]["log_id"] for i in range(3) if got[t[0]][f"last_{i}"] is not None]
        assert have == want


def test_repeated_failures(log):
    L, T, logins, trades = log
    got = {r["rowkey"]: r for r in families.repeated_failure_flags(L, T, DAYS).collect()}
    for t in trades:
        for d in DAYS:
            rows = sorted(before(logins, t, d), key=lambda r: (r[2], r[0]))
            flag = len(rows) > 2 and any(a[3] < 0 and b[3] < 0 for a, b in zip(rows, rows[1:]))
            assert got[t[0]][f"multiple_fails_{d}"] == int(flag), (t, d)


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def spread(values):
    if not values:
        return dict.fromkeys(("mean", "max", "min", "med", "std"))
    return {
        "mean": mean(values), "max": max(values), "min": min(values), "med": median(values),
        "std": pstdev(values) if len(values) > 1 else None,
    }


@pytest.mark.parametrize("frame_rows", [5_000, 40])
def test_durations(log, frame_rows):
    L, T, logins, trades = log
    got = {r["rowkey"]: r for r in families.duration_statistics(L, T, (7, 1), frame_rows=frame_rows).collect()}
    assert len(got) == len(trades)
    for t in trades:
        for d in (7, 1):
            want = spread([math.log(r[4] + 1) for r in before(logins, t, d)])
            for s, v in want.items():
                assert close(got[t[0]][f"timelong_{s}_{d}"], v), (t, d, s, got[t[0]][f"timelong_{s}_{d}"], v)


@pytest.mark.parametrize("frame_rows", [5_000, 40])
def test_recovery(log, frame_rows):
    L, T, logins, trades = log
    got = {r["rowkey"]: r for r in families.recovery_statistics(L, T, (7,), frame_rows=frame_rows).collect()}
    assert len(got) == len(trades)
    for t in trades:
        rows = sorted(before(logins, t, 7), key=lambda r: (r[2], r[0]))
        gaps = [math.log((b[2] - a[2]) / 1e6 + 1) for a, b in zip(rows, rows[1:]) if a[3] < 0]
        if sum(r[3] for r in rows) < 1 or len(rows) < 2:
            gaps = []
        for s, v in spread(gaps).items():
            assert close(got[t[0]][f"after_fail_{s}_7"], v), (t, s)


@pytest.mark.parametrize("frame_rows", [5_000, 5])
@pytest.mark.parametrize("values", [[1_000_000_007] * 30, [2 * 10**12 + i for i in range(30)], [2**62 - i for i in range(30)], [0] * 30])
def test_statistics_of_large_and_equal_values(spark, values, frame_rows):
    events = spark.createDataFrame([(1, i, v, i) for i, v in enumerate(values)], "id long, us long, code long, event long")
    queries = spark.createDataFrame([(0, 1, 10**6), (1, 1, 0), (2, None, 10**6)], "rowkey long, id long, us long")
    got = {r.rowkey: r for r in families.value_statistics(events, queries, (1,), lambda c: c.cast("double"), frame_rows=frame_rows).collect()}
    assert len(got) == 3 and got[0].n_1 == len(values) and got[1].n_1 == got[2].n_1 == 0 and got[2].mean_1 is None
    want = spread([float(v) for v in values])
    for s in ("mean", "max", "min", "med"):
        assert close(got[0][f"{s}_1"], want[s])
    # To the digits of the scaled values; equal values have no deviation at all.
    assert abs(got[0].std_1 - pstdev(values)) <= 2**-44 * max(1, max(values)) and (len(set(values)) > 1 or got[0].std_1 == 0)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_statistics_of_the_largest_values_in_both_modes(spark, ansi):
    values = [2**63 - 1, 2**63 - 2**40, 2**60, 2**60 - 1, 5]
    events = spark.createDataFrame([(1, i, v, i) for i, v in enumerate(values)], "id long, us long, code long, event long")
    queries = spark.createDataFrame([(0, 1, 10**6)], "rowkey long, id long, us long")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = families.value_statistics(events, queries, (1,), lambda c: c.cast("double"), frame_rows=2).first()
        assert (got.max_1, got.min_1, got.med_1) == (float(values[0]), 5.0, float(2**60))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def counts(values):
    out = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


@pytest.mark.parametrize("step", [10, 2])
def test_repeat_statistics(log, step, monkeypatch):
    monkeypatch.setattr(categories, "STEP", step)
    L, T, logins, trades = log
    got = {r["rowkey"]: r for r in categories.repeat_statistics(L, T, "device", DAYS).collect()}
    assert len(got) == len(trades)
    for t in trades:
        for d in DAYS:
            rows = sorted(before(logins, t, d), key=lambda r: (r[2], r[0]))
            r = got[t[0]]
            if not rows:
                assert r[f"device_repeat_count_{d}"] is None and r[f"device_used_count_{d}"] is None
                continue
            target = rows[-1][5]
            every = counts(x[5] for x in rows)
            known = {v: n for v, n in every.items() if v is not None}
            own = known.get(target, 0)
            assert r[f"device_repeat_count_{d}"] == own
            assert r[f"device_used_count_{d}"] == len(every)
            assert r[f"device_freq_rank_{d}"] == (1 + sum(n < own for n in known.values()) if own else None)
            assert r[f"device_most_freq_count_{d}"] == (max(known.values()) if known else None)
            assert close(
                r[f"device_max_min_dist_{d}"], (max(known.values()) - min(known.values())) / max(known.values()) if known else None
            )


@pytest.mark.parametrize("step", [1, 3, 40])
def test_lowest_count_of_a_crowded_key(spark, step, monkeypatch):
    """One key holds nine tenths of the queries; blocks of every level, from single numbers to the whole line."""
    monkeypatch.setattr(categories, "STEP", step)
    r = random.Random(step)
    asked = [(i, "hot" if i % 10 else "other", 7, i) for i in range(1_500)]
    lows = {("hot" if r.random() < 0.9 else "other", 7, j, r.randrange((1_500 >> j) + 1)): r.randrange(1, 90) for j in range(11) for _ in range(1 + (300 >> j))}
    looked = spark.createDataFrame(asked, "rowkey long, key string, d int, number long")
    held = spark.createDataFrame([(*k, v) for k, v in lows.items()], "key string, d int, j int, block long, own long")
    got = {x["rowkey"]: x["least"] for x in categories._lowest_over(looked, held, 11, ["rowkey", "d"]).collect()}
    want = {i: min((lows[k] for j in range(11) if (k := (key, d, j, n >> j)) in lows), default=None) for i, key, d, n in asked}
    assert got == {i: v for i, v in want.items() if v is not None}


def test_shared_value_profile(log):
    L, T, logins, trades = log
    got = {r["rowkey"]: r for r in categories.shared_value_profile(L, T, "device", DAYS).collect()}
    assert len(got) == len(trades)
    for t in trades:
        mine = sorted(before(logins, t), key=lambda r: (r[2], r[0]))
        device = mine[-1][5] if mine else None
        for d in DAYS:
            rows = [] if device is None else before(logins, t, d, key=5, value=device)
            users = counts(r[1] for r in rows if r[1] is not None)
            r = got[t[0]]
            assert r[f"device_login_count_{d}"] == len(rows)
            assert r[f"device_same_id_login_count_{d}"] == users.get(t[1], 0)
            assert r[f"device_most_used_id_counts_{d}"] == max(users.values(), default=0)


def test_target_encoding(log):
    _, T, _, trades = log
    got = {r["rowkey"]: r["id_t_encoding"] for r in encoding.past_target_encoding(T, {"id": F.col("id")}).collect()}
    for t in trades:
        labels = [x[3] for x in trades if t[1] is not None and x[1] == t[1] and x[2] < t[2] and x[3] is not None]
        assert close(got[t[0]], sum(labels) / len(labels) if labels else 0.0)
