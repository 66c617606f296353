"""Causal technical indicators of each symbol's daily bars.

Window functions share one exchange and one sort by (symbol, date). The exponential averages, a recursion without a
built-in counterpart, run on the same partitions as they stand: whole series, in date order, in Arrow slabs. A series
has at most one bar per day.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapemill.operators.slabs import slab_map, values

WARMUP = 49
RAW = ("open", "high", "low", "close", "volume")
DERIVED = ("previous_close", "simple_return", "log_return", "high_low_range", "open_close_return")
INDICATORS = ("rolling_volatility_20", "sma_20", "sma_50", "ema_20", "ema_50", "rsi_14", "macd", "macd_signal", "macd_histogram", "bollinger_middle", "bollinger_upper", "bollinger_lower", "true_range", "atr_14", "obv", "volume_ma_20")
FEATURES = (*RAW, *DERIVED, *INDICATORS)
_RECURSIVE = ("ema_20", "ema_50", "rsi_14", "macd", "macd_signal")


def guarded(aggregate: Column, of: Column, n: int, frame) -> Column:
    """The aggregate where its frame holds at least ``n`` non-null values, as a rolling window with min_periods does."""
    return F.when(F.count(of).over(frame) >= n, aggregate.over(frame))


def ewm(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Exponential average, recursive form: NaNs decay the past's weight and carry its value; NaN below ``least``."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def recursive_features(close: np.ndarray) -> dict[str, np.ndarray]:
    """The exponential indicators of one series in date order."""
    span = lambda x, n: ewm(x, 2 / (n + 1), n)
    change = np.diff(close, prepend=np.nan)
    gain, loss = ewm(np.maximum(change, 0), 1 / 14, 14), ewm(-np.minimum(change, 0), 1 / 14, 14)
    with np.errstate(all="ignore"):
        rsi = 100 - 100 / (1 + gain / loss)
    rsi = np.where((loss == 0) & (gain > 0), 100.0, np.where((loss == 0) & (gain == 0), 50.0, rsi))
    macd = span(close, 12) - span(close, 26)
    return {"ema_20": span(close, 20), "ema_50": span(close, 50), "rsi_14": rsi, "macd": macd, "macd_signal": span(macd, 9)}


def _recursive(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    close = values(table, "close")
    out = {c: np.full(len(close), np.nan) for c in _RECURSIVE}
    for a, b in zip(starts, [*starts[1:], len(close)], strict=True):
        for c, x in recursive_features(close[a:b]).items():
            out[c][a:b] = x
    for c, x in out.items():
        table = table.append_column(c, pa.array(x, mask=np.isnan(x)))
    yield table


def calculate_features(bars: DataFrame, wanted: Sequence[str] = FEATURES) -> DataFrame:
    """Each bar with the ``wanted`` features and ``is_warmup``; needs symbol, date and the five raw columns, drops others.

    With all of them there is ``is_complete`` too: no feature but the previous close is missing. What is not wanted is
    not computed: Catalyst prunes windows, and the recursive stage is left out or handed only what passes through it.
    Null or NaN inputs are missing: a rolling figure needs its full count of present values. Rows without a date sort
    last. A null symbol is a series of its own. Dates of a symbol must be unique (see ``quality``).
    """
    w = Window.partitionBy("symbol").orderBy(F.col("date").asc_nulls_last())
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    full = w.rowsBetween(Window.unboundedPreceding, 0)
    num = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in RAW}
    df = bars.select("symbol", "date", *num.values())
    close, prev = F.col("close"), F.col("previous_close")
    df = df.withColumns({"previous_close": F.lag("close").over(w), "_n": F.row_number().over(w)})
    df = df.withColumns({
        "simple_return": F.try_divide(close, prev) - 1,
        "log_return": F.ln(F.when(close > 0, close) / F.when(prev > 0, prev)),
        "high_low_range": F.col("high") - F.col("low"),
        "open_close_return": F.try_divide(close - F.col("open"), F.col("open")),
        "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "_flow": F.when(F.col("_n") == 1, F.when(close.isNotNull() & F.col("volume").isNotNull(), 0.0)).otherwise(F.signum(close - prev) * F.col("volume")),
    })
    mean = lambda c, n: guarded(F.avg(c), F.col(c), n, last(n))
    df = df.withColumns({
        "rolling_volatility_20": guarded(F.stddev_samp("simple_return"), F.col("simple_return"), 20, last(20)),
        "sma_20": mean("close", 20), "sma_50": mean("close", 50), "atr_14": mean("true_range", 14), "volume_ma_20": mean("volume", 20),
        "_spread": guarded(F.stddev_pop("close"), close, 20, last(20)),
        "obv": F.when(F.count("_flow").over(full) == F.col("_n"), F.sum("_flow").over(full)),
    })
    sources = {"macd_histogram": ("macd", "macd_signal"), "bollinger_middle": ("sma_20",), "bollinger_upper": ("sma_20", "_spread"), "bollinger_lower": ("sma_20", "_spread")}
    needed = {n for c in wanted for n in sources.get(c, (c,))}
    recursive = [c for c in _RECURSIVE if c in needed]
    if recursive:
        df = df.select("symbol", "date", "_n", *dict.fromkeys(["close", *[c for c in df.columns if c in needed]]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + ", ".join(f"{c} double" for c in _RECURSIVE)
        df = slab_map(df, ["symbol"], ["_n"], _recursive, schema, clustered=True)
    two = 2 * F.col("_spread")
    derived = {"macd_histogram": F.col("macd") - F.col("macd_signal") if recursive else None, "bollinger_middle": F.col("sma_20"), "bollinger_upper": F.col("sma_20") + two, "bollinger_lower": F.col("sma_20") - two}
    df = df.withColumns({c: derived[c] for c in derived if c in wanted} | {"is_warmup": F.col("_n") <= WARMUP})
    complete = [(~missing_feature()).alias("is_complete")] if set(FEATURES) <= set(wanted) else []
    return df.select("symbol", "date", *wanted, "is_warmup", *complete)


def missing_feature() -> Column:
    bad = F.lit(False)
    for c in (*RAW, *(d for d in DERIVED if d != "previous_close"), *INDICATORS):
        bad |= F.col(c).isNull()
    return bad


def usable_rows(features: DataFrame) -> DataFrame:
    """Rows past the warm-up in which no feature is missing."""
    return features.where(~F.col("is_warmup") & F.col("is_complete"))


def build_metrics(features: DataFrame) -> DataFrame:
    """One row: input, output, warm-up and missing row counts, dates of the output and its symbols."""
    usable = ~F.col("is_warmup") & F.col("is_complete")
    return features.agg(
        F.count("*").alias("input_rows"), F.count_if(usable).alias("output_rows"), F.count_if("is_warmup").alias("warmup_rows_removed"), F.count_if(~F.col("is_warmup") & ~F.col("is_complete")).alias("missing_rows"),
        F.min(F.when(usable, F.col("date"))).alias("earliest_date"), F.max(F.when(usable, F.col("date"))).alias("latest_date"), F.array_join(F.array_sort(F.collect_set(F.when(usable, F.col("symbol")))), ",").alias("symbols"),
    )
