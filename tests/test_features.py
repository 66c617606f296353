"""Indicators of the series of the daily bars, against brute force in pandas."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from tapemill.plans import registry


def test_features_of_every_series(spark, sf):
    con = duckdb.connect()
    bars = con.execute(f"select feed, upper(trim(symbol)) as symbol, date, open, high, low, close, volume from '{sf}/market_bars.parquet' where date is not null qualify row_number() over (partition by feed, upper(trim(symbol)), date order by ingested_at desc nulls last, bar_id desc) = 1").df()
    got = registry.queries()["features_full"](spark, sf).toPandas()
    got["key"] = [tuple(s.split("/")) for s in got["symbol"]]
    series = {k: g.sort_values("date") for k, g in bars.groupby(["feed", "symbol"])}
    assert set(got["key"]) == set(series) and len(got) == len(bars)
    assert any(symbol == "MKTX" for _, symbol in series) and bars["close"].isna().any()
    for key, mine in got.groupby("key"):
        own, mine = series[key], mine.sort_values("date")
        close, volume = own["close"].astype(float).reset_index(drop=True), own["volume"].astype(float).reset_index(drop=True)
        macd = close.ewm(span=12, adjust=False, min_periods=12).mean() - close.ewm(span=26, adjust=False, min_periods=26).mean()
        want = {
            "close": close, "previous_close": close.shift(), "simple_return": close / close.shift() - 1, "sma_20": close.rolling(20).mean(), "sma_50": close.rolling(50).mean(), "volume_ma_20": volume.rolling(20).mean(),
            "ema_20": close.ewm(span=20, adjust=False, min_periods=20).mean(), "ema_50": close.ewm(span=50, adjust=False, min_periods=50).mean(), "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False, min_periods=9).mean(), "bollinger_upper": close.rolling(20).mean() + 2 * close.rolling(20).std(ddof=0),
        }
        for c, w in want.items():
            assert np.allclose(pd.to_numeric(mine[c]).to_numpy(dtype=float), w.to_numpy(dtype=float), rtol=1e-6, atol=2e-6, equal_nan=True), (key, c)
