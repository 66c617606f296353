"""Golden values and edge cases of indicators, indices, registry, datasets, planning and parsers."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapemill.functions import display
from tapemill.operators import datasets, dedup, explore, indicators, indices, planner, quality, registry
from tapemill.sources import files, parsers

BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"


def ramp(symbol, n, start=1.0, first=date(2025, 1, 1), volume=100):
    return [(symbol, first + timedelta(i), start + i - 0.5, start + i + 1, start + i - 1, start + i, volume) for i in range(n)]


def test_ramp_has_known_indicators(spark):
    """W1-W17 on 60 rows of a ramp."""
    got = indicators.calculate_features(spark.createDataFrame(ramp("MCB", 60), BARS)).orderBy("date").collect()
    last = got[-1]
    want = {"rsi_14": 100.0, "macd": 6.8669642870, "macd_signal": 6.8053137565, "bollinger_middle": 50.5, "bollinger_upper": 62.0325625947, "bollinger_lower": 38.9674374053, "atr_14": 2.0, "obv": 5900.0}
    assert all(abs(last[k] - v) < 1e-9 for k, v in want.items())
    assert sum(r["is_warmup"] for r in got) == 49
    for c, first in {"simple_return": 1, "rolling_volatility_20": 20, "sma_20": 19, "sma_50": 49, "ema_20": 19, "ema_50": 49, "rsi_14": 14, "macd": 25, "macd_signal": 33, "atr_14": 13, "volume_ma_20": 19, "true_range": 0, "obv": 0}.items():
        assert [r[c] is None for r in got].index(False) == first, c


def test_indicators_are_causal_isolated_and_null_safe(spark):
    a, b = ramp("A", 80), ramp("B", 80, 500.0)
    both = {(r["symbol"], r["date"]): r for r in indicators.calculate_features(spark.createDataFrame(a + b, BARS)).collect()}
    part = indicators.calculate_features(spark.createDataFrame(a[:60], BARS)).collect()
    assert all(both[r["symbol"], r["date"]] == r for r in part)
    holes = [(*r[:5], None if i in (5, 40) else r[5], None if i == 50 else r[6]) for i, r in enumerate(a)]
    got = [r for r in indicators.calculate_features(spark.createDataFrame(holes, BARS)).orderBy("date").collect()]
    close = pd.Series([np.nan if r[5] is None else r[5] for r in holes])
    for c, want in {"ema_20": close.ewm(span=20, adjust=False, min_periods=20).mean(), "sma_20": close.rolling(20).mean()}.items():
        assert np.allclose([np.nan if r[c] is None else r[c] for r in got], want, equal_nan=True), c
    assert got[4]["obv"] is not None and all(r["obv"] is None for r in got[5:])  # a missing step poisons what follows
    flat = indicators.calculate_features(spark.createDataFrame([("A", date(2025, 1, 1) + timedelta(i), 5.0, 5.0, 5.0, 5.0, 1) for i in range(20)], BARS)).orderBy("date").collect()
    assert flat[-1]["rsi_14"] == 50.0
    assert indicators.calculate_features(spark.createDataFrame([], BARS)).count() == 0


def series(codes, n=80):
    rows = []
    for code, (a, b, v) in codes.items():
        rows += [(code, date(2025, 1, 1) + timedelta(i), a + (b - a) * i / (n - 1), v if i == n - 1 else 1000) for i in range(n)]
    return rows


INDEX = "index_code string, date date, value double, volume bigint"


def test_health(spark):
    """M1, M3, M4, A4."""
    df = spark.createDataFrame(series({"KSE100": (100, 200, 1500), "KSE30": (200, 100, 800), "KMI30": (100, 105, 1000), "ALLSHR": (100, 150, 1200)}), INDEX)
    figures = indices.metrics(df)
    got = {r["index_code"]: r for r in indices.index_health(figures).collect()}
    assert got["KSE100"]["label"] == "Strongly Bullish" and got["KSE30"]["label"] == "Strongly Bearish" and got["KSE100"]["coverage_percentage"] == 100.0
    changes = spark.createDataFrame([("A", date(2025, 1, 1), 1.0, 10), ("B", date(2025, 1, 1), -1.0, 20), ("A", date(2025, 1, 2), 0.0, 30), ("B", date(2025, 1, 2), None, 1)], "symbol string, date date, change double, volume bigint")
    breadth = indices.breadth(changes)
    row = breadth.first()
    assert (row["reference_date"], row["universe_size"], row["advance_decline_ratio"], row["total_volume"]) == (date(2025, 1, 2), 1, None, 30.0)
    assert indices.breadth(changes.where("date < '2025-01-02' and symbol = 'A'")).first()["advance_decline_ratio"] == math.inf
    assert indices.market_health(figures, breadth).first()["available_weight"] == 85
    one = indices.index_health(indices.metrics(df.limit(0))).collect()
    assert one == [] and {r["label"] for r in indices.health_comparison(indices.index_health(figures.limit(0))).collect()} == {"Unavailable"}
    single = indices.metrics(df.where("date = '2025-01-01'")).first()
    assert single["maximum_return"] == 0.0 and single["one_week_return"] is None


def test_context_join(spark):
    """The newest row is taken as a row, nulls included."""
    wide = indices.context(spark.createDataFrame(series({"KSE100": (100, 159, 1)}, 60), INDEX))
    assert {r["date"].day: r["kse100_value"] for r in wide.where("date <= '2025-01-04'").collect()}[3] == 102
    rows = spark.createDataFrame([("A", date(2025, 3, 1)), ("A", date(2025, 3, 2)), ("A", date(2025, 3, 10)), ("A", None)], "symbol string, date date")
    sparse = spark.createDataFrame([(date(2025, 2, 28), 1.0), (date(2025, 3, 1), None)], "date date, kse100_value double")
    got = {r["date"]: (r["context_date"], r["kse100_value"]) for r in indices.join_context(rows, sparse, 3).collect()}
    assert got == {date(2025, 3, 1): (date(2025, 3, 1), None), date(2025, 3, 2): (date(2025, 3, 1), None), date(2025, 3, 10): (None, None), None: (None, None)}
    with pytest.raises(ValueError):
        indices.join_context(rows, sparse, -1)


def test_zero_base_and_ranges(spark):
    df = spark.createDataFrame([("Z", date(2025, 1, 1), 0.0, 1), ("Z", date(2025, 1, 2), 5.0, 1), ("Y", date(2025, 1, 31), 5.0, 1), ("Y", date(2025, 3, 31), 6.0, 1)], INDEX)
    assert {r["index_code"] for r in indices.normalized(df).collect()} == {"Y"}
    assert indices.range_filter(df, "1M").count() == 1 and indices.range_filter(df, "Maximum").count() == 4
    with pytest.raises(ValueError):
        indices.range_filter(df, "2W")


def test_dedup(spark):
    """Ties, nulls and repeated rows."""
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 2, 6.0), (None, 1, 1.0), (None, None, 2.0)], "k string, at int, v double")
    assert {(r["k"], r["v"]) for r in dedup.keep_last(df, ["k"], ["at", "v"]).collect()} == {("a", 6.0), (None, 1.0)}
    assert tuple(dedup.duplicate_count(df, ["k"]).first()) == (5, 2, 3)
    assert {(r["k"], r["payloads"]) for r in dedup.conflicts(df, ["k"], ["v"], "at", "v").collect()} == {("a", 2), (None, 2)}
    with pytest.raises(ValueError):
        dedup.assert_one(df, ["k"], "df")


def test_quality(spark):
    """F11, F12, F16."""
    rows = [("A", date(2025, 1, 1), 1.0, 2.0, 3.0, 2.5, 1), ("A", date(2025, 1, 1), 1.0, None, 0.0, 1.0, -1), (" ", None, 1.0, 1.0, 1.0, 1.0, 1), ("B", None, 1.0, 1.0, 1.0, float("nan"), 1), ("C", date(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)]
    got = {r["symbol"]: r["errors"] for r in quality.fatal_errors(spark.createDataFrame(rows, BARS)).collect()}
    assert got == {"A": "missing or invalid OHLCV value; duplicate trading date; high is lower than low; volume is negative; price is not positive", "<missing>": "symbol is empty", "B": "invalid trading date; missing or invalid OHLCV value"}


def test_registry(spark):
    """J1, J10, X6-X10, J8."""
    listing = "symbol string, company_name string, security_type string, sector string, board string, listing_segment string, officially_listed boolean, official_status string, source string, non_compliance_reason string"
    listings = spark.createDataFrame([("ACTIVE", "An  Active Co", "ordinary_equity", "s", "main", "n", True, "Listed", "page", None), ("NOHISTORY", "x", "etf", "s", "main", "n", True, None, "page", "late")], listing)
    bars = spark.createDataFrame([("ACTIVE", date(2026, 7, 1)), ("ACTIVE", date(2026, 7, 1)), ("FUT-AUG", date(2026, 7, 30)), (None, date(2026, 7, 30)), ("OLD", date(2025, 7, 30))], "symbol string, date date")
    history = registry.history_ranges(bars)
    base = registry.merge(listings, history, date(2026, 7, 31))
    got = {r["symbol"]: r for r in base.collect()}
    assert (got["ACTIVE"]["lifecycle_status"], got["ACTIVE"]["trading_days"], got["ACTIVE"]["company_name"]) == ("newly_listed", 1, "An Active Co")
    assert (got["NOHISTORY"]["activity_status"], got["NOHISTORY"]["lifecycle_status"], got["NOHISTORY"]["notes"]) == ("never_seen_in_market_history", "listed_not_recently_traded", "late")
    assert (got["FUT-AUG"]["lifecycle_status"], got["FUT-AUG"]["security_type"], got["OLD"]["security_type"]) == ("historical_only", "other", "unknown")
    narrow = {r["symbol"]: r for r in registry.merge(listings, history, date(2026, 7, 31), recent=29, new=29).collect()}
    assert narrow["ACTIVE"]["lifecycle_status"] == "listed_not_recently_traded"
    schema = "symbol string, company_name_override string, official_status_override string, previous_symbol string, successor_symbol string, corporate_action_type string, notes string"
    done = {r["symbol"]: r for r in registry.override(base, spark.createDataFrame([("ACTIVE", "New", "suspended", "OLD", None, " ", "seen")], schema)).collect()}
    a = done["ACTIVE"]
    assert (a["company_name"], a["lifecycle_status"], a["previous_symbol"], a["successor_symbol"], a["notes"], a["source"]) == ("New", "suspended", "OLD", "", "seen", "page; manual_override")
    with pytest.raises(ValueError):
        registry.override(base, spark.createDataFrame([("NONE", None, None, None, None, None, None)], schema))
    small = registry.override(base, spark.createDataFrame([(" active ", "ppl")], "symbol string, successor_symbol string")).where("symbol = 'ACTIVE'").first()
    assert small["successor_symbol"] == "PPL" and small["source"] == "page; manual_override"
    for columns, rows in (("symbol string, other string", [("ACTIVE", "x")]), ("symbol string", [("ACTIVE",), ("active ",)]), ("symbol string", [(" ",)]), ("symbol string, official_status_override string", [("ACTIVE", "gone")]), ("notes string", [("x",)])):
        with pytest.raises(ValueError, match="overrides"):
            registry.override(base, spark.createDataFrame(rows, columns))
    kinds = [("X", "Some RIGHTS issue", "", "main"), ("ABETF", "x", "", "main"), ("X", "Pref", "s", "gem"), ("X", "x", "s", "gem"), ("X", "A REIT", "s", "main"), ("X", "BRIGHT", "s", "main"), (None, None, None, None)]
    types = [r[0] for r in spark.createDataFrame(kinds, "a string, b string, c string, d string").select(registry.security_type(*map(F.col, "abcd"))).collect()]
    assert types == ["right", "etf", "preference_share", "gem_equity", "other", "ordinary_equity", "ordinary_equity"]


REGISTRY = "symbol string, company_name string, officially_listed boolean, activity_status string, official_status string, lifecycle_status string, security_type string, is_new_listing boolean"


def test_datasets(spark):
    """Builds, splits, scaling, readiness."""
    bars = spark.createDataFrame(ramp("786", 310, 10.0) + ramp("HIST", 70, 10.0) + ramp("FUND", 310, 10.0) + ramp("BAD", 310, 10.0) + ramp("BAD", 1, 10.0), BARS)
    reg = spark.createDataFrame([(s, s, True, "recently_traded", "listed", "x", t, False) for s, t in (("786", "ordinary_equity"), ("HIST", "ordinary_equity"), ("FUND", "etf"), ("BAD", "ordinary_equity"))], REGISTRY)
    features = datasets.prepared(bars, reg)
    built = datasets.symbol_datasets(features)
    assert {r["symbol"]: r["count"] for r in built.groupBy("symbol").count().collect()} == {"786": 261}
    report = {r["symbol"]: r for r in datasets.readiness(bars, reg, features, built).collect()}
    assert [report["786"][c] for c in ("train_rows", "validation_rows", "test_rows", "readiness_status")] == [182, 39, 40, "Ready"]
    assert {s: r["readiness_status"] for s, r in report.items()} == {"786": "Ready", "HIST": "Insufficient History", "FUND": "Unsupported Security Type", "BAD": "Data Quality Issue"}
    assert report["HIST"]["additional_rows_required"] == 252 - 21
    assert datasets.readiness(bars, reg, features, built.limit(0)).where("symbol = '786'").first()["readiness_status"] == "Missing Processed Dataset"
    split = datasets.chronological_split(spark.createDataFrame([(s, date(2025, 1, 1) + timedelta(i), float(i)) for i in range(20) for s in "ab"], "symbol string, date date, open double"), "master")
    assert {r["split"]: r["rows"] for r in datasets.split_metadata(split).collect()} == {"train": 28, "validation": 6, "test": 6}
    small = lambda last: spark.createDataFrame([("train", 0.0, 5.0), ("train", 2.0, 5.0), ("validation", 100.0, 6.0), ("test", 200.0, last)], "split string, open double, flat double")
    scaled = datasets.scale(small(4.0), datasets.fit_scaler(small(4.0), ["open", "flat"]), ["open", "flat"]).collect()
    assert [r["open"] for r in scaled] == [-1.0, 1.0, 99.0, 199.0] and [r["flat"] for r in scaled] == [0.0, 0.0, 1.0, -1.0]
    for bad in (None, float("nan"), float("inf")):
        assert datasets.fit_scaler(small(bad), ["open", "flat"]).first()["non_finite_rows"] == 1
        with pytest.raises(Exception, match="finite values in every part"):
            datasets.scale(small(bad), datasets.fit_scaler(small(bad), ["open", "flat"]), ["open", "flat"]).collect()
    for rows, scope in (([("a", 1), ("a", 2)], "symbol"), ([("a", 1), ("b", 2), ("b", 3)], "symbol")):
        with pytest.raises(ValueError, match="cannot be split"):
            datasets.checked_split(spark.createDataFrame([(x, date(2025, 1, d)) for x, d in rows], "symbol string, date date"), scope)
    with pytest.raises(ValueError):
        datasets.chronological_split(split, "master", (0.5, 0.5, 0.5))


def test_datasets_with_context_are_kept(spark, tmp_path):
    """The 44 columns, and every feature scaled."""
    bars = spark.createDataFrame([(" 786 " if i % 3 else "786", *b[1:]) for i, b in enumerate(ramp("786", 120, 10.0))] + ramp(" BAD", 60, 10.0) + ramp("BAD", 1, 10.0), BARS)
    reg = spark.createDataFrame([(s, s, True, "recently_traded", "listed", "x", "ordinary_equity", False) for s in ("786", "BAD")], REGISTRY)
    dates = [r["date"] for r in bars.select("date").distinct().orderBy("date").collect()]
    series = spark.createDataFrame([(c, d, 100.0 + i, 5, 1.0) for c in indices.INDEX_CODES for i, d in enumerate(dates) if i % 2 == 0], "index_code string, date date, value double, volume bigint, open double")
    rows = datasets.dataset_rows(datasets.master_dataset(datasets.prepared(bars, reg, indices.context(series), 3)))
    assert rows.columns == list(datasets.COLUMNS) and len(datasets.COLUMNS) == 44
    got = {r["date"]: r for r in rows.collect()}
    assert {r["symbol"] for r in got.values()} == {"786"} and len(got) == 120 - 49  # one series whatever its spelling; the faulty one is out
    at = dates.index(max(got))
    assert got[dates[at]]["kse100_value"] == 100.0 + at - at % 2 and got[dates[at]]["market_health_score"] is None
    exact = datasets.prepared(bars, reg, indices.context(series)).where(F.col("date") == dates[1]).first()
    assert exact["kse100_value"] is None and exact["sma_20"] is None
    features = [c for c in indicators.FEATURES if c in datasets.COLUMNS]
    split = datasets.checked_split(rows, "symbol")
    kept = datasets.persist_split(split, features, str(tmp_path / "split"))
    train = kept["scaled"].where("split = 'train'").agg(*[F.avg(c).alias(c) for c in features]).first()
    assert all(abs(train[c]) < 1e-9 for c in features) and kept["raw"].count() == kept["scaled"].count() == len(got)
    assert {r["feature"] for r in kept["scaler"].collect()} == set(features) and {r["split"] for r in kept["metadata"].collect()} == {"train", "validation", "test"}
    with pytest.raises(ValueError, match="no finite numbers"):
        datasets.persist_split(split.withColumn("obv", F.when(F.col("split") == "test", float("inf")).otherwise(F.col("obv"))), features, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    one = indices.single_index(series, "KSE30", "KSE-30").collect()
    assert [r["date"] for r in one] == dates[::2] and {r["index"] for r in one} == {"KSE-30"}


def test_new_model_records(spark):
    """M23, X30."""
    models = files.projected(spark.createDataFrame([("symbol", "A/B", 3), ("master", None, 1)], "model_scope string, symbol string, model_version bigint"), files.MODELS, files.MODEL_TYPES)
    got = {r["symbol"]: r for r in datasets.new_models(models, spark.createDataFrame([("symbol", " A/B "), ("symbol", "NEW"), ("master", None)], "model_scope string, symbol string")).collect()}
    assert {s: (r["model_id"], r["model_version"]) for s, r in got.items()} == {"A/B": ("ppo-symbol-A_B-v0004", 4), "NEW": ("ppo-symbol-NEW-v0001", 1), None: ("ppo-master-master-v0002", 2)}
    assert got["A/B"]["model_path"] == "symbols/A_B/v0004/model" and got[None]["model_status"] == "not_trained" and tuple(got[None].asDict()) == files.MODELS
    for rows, schema in (([("all", "x")], "model_scope string, symbol string"), ([("symbol", " ")], "model_scope string, symbol string"), ([("master", None, 1)], "model_scope string, symbol string, other int")):
        with pytest.raises(ValueError, match="new models"):
            datasets.new_models(models, spark.createDataFrame(rows, schema))


def test_split_sizes_follow_truncation(spark):
    for n in (3, 4, 7, 20, 100, 261):
        train, val = max(1, int(n * 0.7)), max(1, int(n * 0.15))
        if train + val >= n:
            train, val = n - 2, 1
        labels = [r[0] for r in spark.range(1, n + 1).select(datasets.split_label(F.col("id"), F.lit(n))).collect()]
        assert (labels.count("train"), labels.count("validation"), labels.count("test")) == (train, val, n - train - val)


def test_model_status(spark):
    """Four new days after the cutoff."""
    bars = spark.createDataFrame(ramp("786", 60, 10.0, first=date(2026, 1, 1)), BARS)
    reg = spark.createDataFrame([("786", "c", True, "recently_traded", "listed", "x", "ordinary_equity", True), ("GONE", "c", False, "recently_traded", "listed", "x", "ordinary_equity", True)], REGISTRY)
    models = spark.createDataFrame([("m1", "symbol", "786", 1, "trained", date(2026, 1, 5)), ("m2", "symbol", "786", 2, "trained", date(2026, 2, 25))], "model_id string, model_scope string, symbol string, model_version int, model_status string, training_data_end date")
    got = datasets.symbol_status(bars, reg, models, 11).collect()
    assert [(r["symbol"], r["new_data_days"], r["training_status"], r["usable_rows"]) for r in got] == [("786", 4, "retraining_recommended", 11)]
    assert datasets.symbol_status(bars, reg.limit(0), models).count() == 0
    assert datasets.master_status(bars, models).first()["training_status"] == "never_trained"
    with pytest.raises(ValueError):
        datasets.append_model(models, models)
    assert spark.range(1).select(datasets.model_id(F.lit("symbol"), F.lit("7/86"), F.lit(2))).first()[0] == "ppo-symbol-7_86-v0002"


def test_pages(spark):
    """O3."""
    assert explore.page_bounds(0, 10, 5) == (1, 1, 0, 0) and explore.page_bounds(25, 10, 9) == (3, 3, 21, 25) and explore.page_bounds(25, 10, "x")[0] == 1
    with pytest.raises(ValueError):
        explore.page_bounds(5, 0, 1)
    df = spark.range(100).withColumn("d", F.col("id") % 7)
    order = [F.col("d").desc(), F.col("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    assert [r["id"] for r in explore.paginate(df, order, 30, 2).collect()] == want[30:60]
    assert [r["id"] for r in sorted(explore.numbered(df, order).collect(), key=lambda r: r["row"])] == want
    assert explore.merged_selection(["a", "b"], ["b", "c"], ["c"], ["c", "b", "a"]) == ["c", "a"]


def test_planner(spark, tmp_path):
    """T1-T8."""
    days = planner.calendar(spark, date(2026, 7, 4), date(2026, 7, 8))
    have = spark.createDataFrame([(date(2026, 7, 6),)], "date date")
    none = spark.createDataFrame([], "date date, state string")
    plan = planner.backfill_plan(days, have, none, date(2026, 8, 1))
    assert {r["date"].day: r["plan"] for r in plan.collect()} == {4: "weekend", 5: "weekend", 6: "existing", 7: "request", 8: "request"}
    assert {r["plan"]: r["minimum_seconds"] for r in planner.plan_totals(plan, 2.0).collect()}["request"] == 2.0
    told = spark.createDataFrame([(date(2026, 7, 4), "temporary_unavailable"), (date(2026, 7, 6), "failed"), (date(2026, 7, 7), "failed"), (date(2026, 7, 8), "non_trading")], "date date, state string")
    labels = lambda retry, today=1: sorted((r["date"].day, r["plan"]) for r in planner.backfill_plan(days, have, told, date(2026, 8, today) if today else date(2026, 7, 8), retry).collect())
    assert labels(False) == [(4, "unresolved"), (4, "weekend"), (5, "weekend"), (6, "existing"), (6, "failed"), (7, "failed"), (8, "non_trading")]
    assert (7, "request") in labels(True) and (8, "unresolved") in labels(False, None)
    assert planner.missing_dates(days, have).count() == 4
    path, todo = tmp_path / "state.json", [date(2026, 7, d) for d in (6, 7, 8)]

    def fetch(day):
        if day.day == 7:
            raise OSError("down")
        return 5 if day.day == 6 else 0

    state = planner.run_backfill(todo, fetch, planner.RunState("a", "b"), path, date(2026, 8, 1), most=2)
    assert (state.status, state.dates) == ("paused", {"2026-07-06": "successful", "2026-07-07": "failed"})
    state = planner.run_backfill(todo, lambda d: 1, planner.RunState.load(path), path, date(2026, 8, 1))
    assert state.status == "completed" and state.last_attempted == "2026-07-08"
    path.write_text("{")
    assert planner.RunState.load(path) is None
    lock = tmp_path / "lock"
    with planner.update_lock(lock):
        with pytest.raises(RuntimeError), planner.update_lock(lock):
            pass
        with planner.update_lock(lock, now=lambda: 9e12):
            pass
    assert not lock.exists()
    assert [v["state"] for v in planner.run_stages([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 2)]).values()] == ["success", "failed", "success"]


def test_parsers(spark):
    """S10-S12."""
    cells = "".join(f'<td data-value="{v}">z</td>' for v in ("220.5", "221", "1,225.25", "219.75", "224", "3.5", "1.59%", "1,234,567"))
    html = f'<table><tr><td>no</td></tr><tr class="a" data-type="equity"><td> A&amp;B <b>x</b></td>{cells}</tr><tr data-type="equity"><td>A</td><td>1</td></tr><tr data-type="equity"><td>OGDC</td>{cells.replace(chr(34) + "221" + chr(34), chr(34) * 2)}</tr></table>'
    got = parsers.equity_rows(spark.createDataFrame([("p", date(2025, 1, 1), html), ("q", date(2025, 1, 1), None)], "page_id string, date date, html string")).orderBy("row_number").collect()
    assert [r["reason"] for r in got] == ["", "expected 9 columns, found 2", "open is empty"]
    assert (got[0]["symbol"], got[0]["high"], got[0]["change_percent"], got[0]["volume"]) == ("A&B x", 1225.25, 1.59, 1234567)
    page = '<table><tr><th>NAME</th><th>Symbol<br></th><th>Shares</th><th>Free Float</th></tr><tr><td>Fund</td><td data-search="acietf">x</td><td>1,000</td><td>N/A</td></tr><tr><td>a</td></tr></table>'
    rows = parsers.listing_rows(spark.createDataFrame([("p", page)], "page_id string, html string")).orderBy("row_number").collect()
    assert [(r["symbol"], r["company_name"], r["shares"], r["free_float"], r["complete"]) for r in rows] == [("ACIETF", "Fund", 1000, None, True), (None, None, None, None, False)]
    payload = '{"status":1,"data":[[1628338541,102,20,101],[1628252141,100.5,10,99],[1,null],[true,1,2,3],["1628252141",1,2,3],[1628252142.5,1,2,3]]}'
    points = parsers.index_points(spark.createDataFrame([("K", payload), ("L", None)], "index_code string, payload string")).orderBy("position").collect()
    assert [r["reason"] == "" for r in points] == [True, True, False, False, False, False]
    faults = [("K", '{"status":1,"data":[[-5,1,2,3],[5,1,-2,3]]}'), ("K", '{"status":0,"data":[[5,1,2,3]]}'), ("K", '{"status":1}'), ("Z", payload)]
    assert sorted(r["reason"] for r in parsers.index_points(spark.createDataFrame(faults, "index_code string, payload string"), codes=["K"]).collect()) == ["no list of data", "status is not 1", "timestamp is negative", "unsupported index", "volume is negative"]
    head = "<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in ("Symbol", "Name", "Sector", "Clearing Type", "Shares", "Free Float", "Listed In", "Non-Compliance Reason")) + "</tr></thead><tbody>"
    line = '<tr><td data-search="abc">x</td><td>A REIT fund</td><td>S</td><td>T+2</td><td>1,000</td><td>-</td><td data-search="KSE100,ALL">2</td><td>late</td></tr>'
    listing = lambda html, segment="dc": parsers.listing_snapshot(spark.createDataFrame([("p", html, "gem", segment, "u")], "page_id string, html string, board string, segment string, source string"), F.lit("2026-07-01 10:00:00").cast("timestamp_ntz"))
    one = listing(head + line).first()
    assert (one["symbol"], one["board"], one["listing_segment"], one["official_status"], one["listed_in"], one["shares"], one["free_float"], one["security_type"]) == ("ABC", "GEM", "non_compliant_segment", "non_compliant", "KSE100,ALL", 1000, None, "gem_equity")
    assert listing(head + line, "normal").columns == list(files.SNAPSHOT) and listing(head + line, "normal").first()["official_status"] == "listed"
    for bad in (head, head.replace("Sector", "Other") + line, head.replace("Non-Comp", "X") + line, head + line.replace("<td>S</td>", ""), head + line.replace(' data-search="abc">x', "> ")):
        with pytest.raises(ValueError, match="listing page p"):
            listing(bad)
    assert (points[0]["date"], points[1]["date"], points[1]["value"]) == (date(2021, 8, 7), date(2021, 8, 6), 100.5)


def test_display(spark):
    """X17-X26."""
    row = spark.createDataFrame([("non_compliant", 1234567.0, -1.5, None, "listing_page; https://x.y/z_a")], "e string, n double, p double, m string, s string")
    times = spark.createDataFrame([("2026-07-30T09:05:00Z",), ("2026-07-30T23:30:00-02:00",), ("2026-07-30T09:05:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in times.select(display.instant_text(F.col("t"))).collect()] == ["30 Jul 2026, 2:05 PM PKT", "31 Jul 2026, 6:30 AM PKT", "30 Jul 2026, 9:05 AM PKT", "—", "—"]
    assert display.labelled(spark.createDataFrame([(1.0, 2.0, "x")], "ldcp double, change_percent double, company_name string")).columns == ["LDCP", "Change %", "Company Name"]
    assert [r[0] for r in spark.createDataFrame([(1.0, -2.0), (None, 0.0), (None, None)], "a double, b double").select(display.trend(F.col("a"), F.col("b"))).collect()] == ["Above SMA-20 · Below SMA-50", "Below SMA-50", ""]
    got = row.select(display.humanized(F.col("e")), display.badge(F.col("e")), display.volume(F.col("n")), display.directional(F.col("p")), display.humanized(F.col("m")), display.source(F.col("s")), display.price(F.col("n")), display.integer(F.col("m"))).first()
    assert tuple(got) == ("Non-Compliant", "orange", "1.2M", "▼ -1.50%", "—", "Listing Page; https://x.y/z_a", "PKR 1,234,567.00", "—")
