"""Trailing figures (P1), spikes (P2) and grids (P5) against brute force, and their edge cases."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from tapemill.operators.grid import local_linear, regular_grid
from tapemill.operators.rolling import disagreeing_figures, trailing_figures
from tapemill.operators.slabs import pieces, segment_median, slab_map
from tapemill.operators.spikes import details, finest_details, implausible_readings, implausible_rows, wavelet_cases
from tests.brute import cases, figures, in_force, key

SCHEMA = "bar_id bigint, symbol string, feed string, date date, close double, volume bigint, change_percent double, ingested_at timestamp_ntz, day int, kind string"
T0, D0 = datetime(2025, 1, 1), date(2025, 1, 1)


def bar(i, symbol, feed, day, close, volume, cp=0.5, at=0):
    return {"bar_id": i, "symbol": symbol, "feed": feed, "date": None if day is None else D0 + timedelta(day), "close": close, "volume": volume, "change_percent": cp, "ingested_at": T0 + timedelta(hours=at), "day": 7, "kind": "clash"}


def noisy(seed, n=260):
    r = random.Random(seed)
    rows, i = [], 0
    for s, feed in (("AB", "x"), ("NULL", "x"), ("AB", None), (None, "x")):
        price, volume = 100.0, 1000
        for day in range(n):
            if r.random() < 0.2:
                continue
            price *= 1 + r.gauss(0, 0.01)
            for version in range(1 + (r.random() < 0.1)):
                i += 1
                close = r.choice([price, price, price, price, None, 0.0, price * 4, float("nan")]) if r.random() < 0.15 else price
                spelled = s if s is None else r.choice([s, f" {s} ", s.lower()])
                rows.append(bar(i, spelled, feed, day, close, r.choice([None, 0, volume, volume + r.randint(0, 90), -5]), r.choice([0.0, 0.5, -1.0, r.gauss(0, 1), None, 60.0]), at=day * 24 + version))
            if r.random() < 0.05:
                for k in range(6):
                    i += 1
                    rows.append(bar(i, s, feed, n + day * 7 + k, 55.5, 10 if k != 3 or r.random() < 0.5 else 0, 2.5, at=9999))
    return rows


def make(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def clean(rows):
    return [{**r, "close": None if r["close"] is not None and r["close"] != r["close"] else r["close"]} for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_figures_equal_brute_force(spark, seed):
    rows = noisy(seed)
    force = in_force(clean(rows))
    got = trailing_figures(make(spark, rows), (7, 20)).collect()
    assert len(got) == sum((max(s) - min(s)).days + 1 for s in force.values())
    for g in got:
        for n in (7, 20):
            want = figures(force[g["symbol"], g["feed"]], g["date"], n)
            have = [g[f"{c}_{n}"] for c in ("volume_total", "volume_ma", "sma", "rolling_volatility")]
            for w, h in zip(want, have, strict=True):
                assert (w is None) == (h is None) and (w is None or abs(w - h) <= 1e-9 * max(1, abs(w))), (g, want)


def test_figures_at_days_without_bars(spark):
    at = spark.createDataFrame([("ab", "x", D0 + timedelta(400)), ("ZZ", None, D0), ("AB", "x", D0)], "symbol string, feed string, date date")
    got = {(r["symbol"], r["date"]): r for r in trailing_figures(make(spark, [bar(1, "AB", "x", 0, 5.0, 3)]), at=at).collect()}
    assert len(got) == 3
    assert got["AB", D0]["volume_total_7"] == 3 and got["AB", D0]["sma_20"] == 5.0 and got["AB", D0]["rolling_volatility_20"] is None
    assert got["ZZ", D0]["volume_total_30"] == 0 and got["ZZ", D0]["sma_20"] is None and got["ZZ", D0]["volume_ma_20"] == 0.0


def test_disagreement_is_by_both_tolerances(spark):
    bars = make(spark, [bar(1, "AB", "x", 0, 5.0, 20)])
    stored = "symbol string, feed string, date date, sma_20 double, volume_ma_20 double, rolling_volatility_20 double, volume_total_7 bigint, volume_total_30 bigint"
    rows = [("AB", "x", D0, 5.0049, 1.0, None, 20, 20), ("AB", "x", D0 + timedelta(1), 5.006, 1.0, None, 20, 20), ("AB", "x", D0 + timedelta(2), 5.0, 1.0, 0.1, 20, 20), ("AB", "x", D0 + timedelta(3), None, 1.0, None, 20, 20), ("AB", "x", D0 + timedelta(4), float("nan"), 1.0, None, 20, 20), ("AB", "x", D0 + timedelta(5), 5.0, 1.0, None, 20, 21), ("AB", "x", D0 + timedelta(6), 5.0, 1.0, None, None, 20)]
    got = disagreeing_figures(bars, spark.createDataFrame(rows, stored))
    assert sorted(r["bar_day"] for r in got.collect()) == [f"2025-01-0{i}" for i in (2, 3, 4, 5, 6, 7)]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_spikes_equal_brute_force(spark, seed):
    rows = noisy(seed)
    want = {(k, d, f) for k, s in in_force(clean(rows)).items() for d, f in cases(s)}
    df = make(spark, rows)
    got = {((r["symbol"], r["feed"]), r["date"], r["field"]) for r in implausible_readings(df).collect()}
    assert got == want and len(want) > 20
    stored = {(r["bar_id"], r["field"]) for r in implausible_rows(df).collect()}
    assert stored == {(r["bar_id"], f) for r in rows for k, d, f in want if (key(r["symbol"]), r["feed"]) == k and r["date"] == d}


def test_a_jump_to_a_new_level_is_no_spike(spark):
    prices = [100 * 1.01 ** (i % 2) for i in range(20)] + [900 * 1.01 ** (i % 2) for i in range(20)]
    rows = [bar(i, "AB", "x", i, p, 100 + i % 3) for i, p in enumerate(prices)]
    assert {r["field"] for r in implausible_readings(make(spark, rows)).collect() if r["reason"] == "spike"} == set()


def test_details_of_every_level_are_differences_of_means():
    r = np.random.default_rng(4)
    group = np.repeat([0, 1], [40, 25])
    x = r.normal(size=65)
    for k, d in enumerate(details(finest_details(x, group), group, 3)):
        h = 1 << k
        for i in range(65):
            inside = group[max(0, i - h)] == group[min(64, i + h - 1)] and i - h >= 0 and i + h <= 65
            assert np.isnan(d[i]) if not inside else abs(d[i] - (x[i : i + h].mean() - x[i - h : i].mean())) < 1e-12


def test_wide_spikes_have_their_width(spark):
    r = random.Random(9)
    price, rows = 100.0, []
    wide = {60: 1, 100: 2, 140: 4, 180: 8}
    for i in range(260):
        price *= 1 + r.gauss(0, 0.002)
        high = any(a <= i < a + w for a, w in wide.items())
        rows.append(bar(i, "AB", "x", i, price * (9 if high else 1), 1000 + r.randint(0, 300), 0.1 * r.random()))
    got = {(c["date"] - D0).days: c["width"] for c in wavelet_cases(make(spark, rows)).collect() if c["field"] == "close" and c["reason"] == "spike"}
    assert got == {60: 1, 100: 2, 101: 2, **{140 + i: 4 for i in range(4)}}
    assert {(c["date"] - D0).days for c in implausible_readings(make(spark, rows)).collect() if c["field"] == "close"} == {60}


def test_grid_fills_and_marks(spark):
    days = [0, 1, 2, 3, 6, 7, 8, 60, 61]
    rows = [bar(i, "AB", "x", d, 10.0 + d, 1) for i, d in enumerate(days)] + [bar(99, "AB", "x", 4, None, 1), bar(98, "AB", "x", 4, 77.0, 1, at=-5), bar(97, "AB", "x", 64, None, 1), bar(96, "AB", "x", None, 5.0, 1)]
    calendar = spark.createDataFrame([(D0 + timedelta(i), i % 7 != 5) for i in range(-5, 80)], "date date, is_open boolean")
    got = {(r["date"] - D0).days: r for r in regular_grid(make(spark, rows), calendar).collect()}
    assert sorted(got) == [i for i in range(65) if i % 7 != 5]
    assert {d for d, r in got.items() if r["status"] == "observed"} == {d for d in days + [4] if d % 7 != 5}
    assert got[4]["close"] == 77.0  # an earlier version's close, where the one in force has none
    assert got[30]["status"] == "missing" and got[30]["close"] is None and got[30]["support"] == 0
    assert got[9]["status"] == "filled" and 15 < got[9]["close"] < 25


FIRST, LAST = date(1, 1, 1), date(9999, 12, 31)


def test_stray_dates_cost_no_more_than_rows(spark):
    rows = [{**bar(i, f"S{i}", "x", 0, 5.0 + i, 10), "date": d} for i in range(400) for d in (FIRST, D0, D0 + timedelta(1), LAST)]
    df = make(spark, rows)
    at = spark.createDataFrame([(f"S{i}", "x", d) for i in range(400) for d in (FIRST, D0 + timedelta(1), D0 + timedelta(40), LAST)], "symbol string, feed string, date date")
    got = {(r["symbol"], r["date"]): r["volume_total_7"] for r in trailing_figures(df, at=at).select("symbol", "date", "volume_total_7").collect()}
    assert set(got.values()) == {10, 20, 0} and all(n == {FIRST: 10, LAST: 10, D0 + timedelta(1): 20}.get(d, 0) for (_, d), n in got.items())
    calendar = spark.createDataFrame([(FIRST + timedelta(3), True), (D0 - timedelta(3), True), (D0, True), (D0 + timedelta(2), True), (D0 + timedelta(500), True), (LAST - timedelta(1), True), (LAST, True)], "date date, is_open boolean")
    grid = regular_grid(df, calendar).where("symbol = 'S7'").collect()
    assert [(r["status"], round(r["support"], 3) > 0) for r in sorted(grid, key=lambda r: r["date"])] == [("missing", True), ("missing", True), ("observed", True), ("missing", True), ("missing", False), ("missing", True), ("observed", True)]


def test_every_day_of_a_long_life_comes_out(spark):
    rows = [{**bar(i, "AB", "x", 0, 5.0, 10), "date": d} for i, d in enumerate((date(1700, 1, 1), date(1700, 1, 3), date(2025, 1, 1)))]
    got = trailing_figures(make(spark, rows), (7,))
    told = got.groupBy("volume_total_7").count().collect()
    assert {r["volume_total_7"]: r["count"] for r in told} == {0: (date(2025, 1, 1) - date(1700, 1, 10)).days, 10: 2 + 2 + 1, 20: 5}


def test_local_linear_reproduces_a_line():
    y = np.arange(50.0)
    known = np.ones(50, bool)
    known[[7, 8, 20, 33]] = False
    fit, support = local_linear(y, known, 6)
    assert np.allclose(fit, y) and (support > 2).all()


@pytest.mark.parametrize("operator", [trailing_figures, implausible_readings, implausible_rows])
def test_empty_tables(spark, operator):
    assert operator(make(spark, [])).count() == 0


def test_empty_grid(spark):
    calendar = spark.createDataFrame([], "date date, is_open boolean")
    assert regular_grid(make(spark, [bar(1, "AB", "x", 0, 5.0, 3)]), calendar).count() == 0
    assert regular_grid(make(spark, []), calendar).count() == 0


def test_slabs_hold_whole_groups(spark):
    import pyarrow as pa

    def sizes(table, starts):
        ends = [*starts[1:], table.num_rows]
        k = table.column("k").to_pylist()
        yield pa.table({"k": pa.array([k[a] for a in starts], pa.string()), "n": pa.array([int(b - a) for a, b in zip(starts, ends, strict=True)])})

    rows = [("a",)] * 700 + [(None,)] * 30 + [(str(i),) for i in range(300)] + [("b",)] * 5000
    got = slab_map(spark.createDataFrame(rows, "k string"), ["k"], [], sizes, "k string, n bigint", slab_rows=64).collect()
    assert {r["k"]: r["n"] for r in got} == {"a": 700, None: 30, "b": 5000} | {str(i): 1 for i in range(300)}
    assert len(got) == 303


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 100])
def test_pieces_number_every_row(limit):
    for many in ([], [0], [3], [0, 2, 0, 0, 5, 1, 0], [7, 7], [1] * 9):
        got = [(int(r), int(n)) for rows, numbers in pieces(np.array(many, np.int64), limit) for r, n in zip(rows, numbers, strict=True)]
        assert got == [(r, n) for r, k in enumerate(many) for n in range(k)]


def test_segment_median():
    g, x = np.array([0, 0, 0, 2, 2]), np.array([3.0, 1, 2, 5, 8])
    assert np.array_equal(segment_median(g, x, 3), [2, np.nan, 6.5], equal_nan=True)
