"""Queries of the indicators, over the readings in force of every series of the daily bars, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.operators import indicators
from tapemill.sources.tables import series_bars

#: The reading in force of each series and day, and all of them as bars, each series a symbol.
DAYS = """
force as (
  select * replace (upper(trim(symbol)) as symbol) from market_bars where date is not null
  qualify row_number() over (partition by feed, upper(trim(symbol)), date order by ingested_at desc nulls last, bar_id desc nulls last) = 1)"""
BARS = f"""
{DAYS},
bars as (select coalesce(feed, '\\N') || '/' || coalesce(symbol, '\\N') as symbol, date, open, high, low, close, volume from force)"""
_ALPHA = {"e12": 2 / 13, "e26": 2 / 27, "e20": 2 / 21, "e50": 2 / 51}


def _walked(state: str, x: str, gap: str, alpha: float) -> str:
    """The exponential average after ``x``, which may be missing, ``gap`` missing ones after the last that was there."""
    keep = f"pow({1 - alpha!r}::double, w.{gap} + 1)"
    return f"case when {x} is null then w.{state} when w.{state} is null then {x} else ({keep} * w.{state} + {alpha!r}::double * {x}) / ({keep} + {alpha!r}::double) end"


_E = {k: _walked(k, "m.close", "gap", a) for k, a in _ALPHA.items()}
_MACD = f"case when m.closes >= 26 then ({_E['e12']}) - ({_E['e26']}) end"

#: The features of whatever ``bars`` holds.
WALK = f"""
seq as (select *, row_number() over w as n, lag(close) over w as previous_close from bars window w as (partition by symbol order by date)),
moves as materialized (
  select *, close / nullif(previous_close, 0) - 1 as simple_return, ln(case when close > 0 then close end / case when previous_close > 0 then previous_close end) as log_return, high - low as high_low_range, (close - open) / nullif(open, 0) as open_close_return,
    greatest(high - low, abs(high - previous_close), abs(low - previous_close)) as true_range, close - previous_close as diff,
    count(close) over w as closes, count(close - previous_close) over w as diffs from seq window w as (partition by symbol order by date)),
walk as (
  select symbol, n, close as e12, close as e26, close as e20, close as e50, case when close is null then 1 else 0 end as gap, cast(null as double) as g, cast(null as double) as l, 0 as wait, cast(null as double) as sig, 0 as signals from moves where n = 1
  union all
  select m.symbol, m.n, {', '.join(_E.values())}, case when m.close is null then w.gap + 1 else 0 end,
    {_walked('g', 'case when m.diff is not null then greatest(m.diff, 0) end', 'wait', 1 / 14)}, {_walked('l', 'case when m.diff is not null then greatest(-m.diff, 0) end', 'wait', 1 / 14)},
    case when m.diff is null then w.wait + 1 else 0 end,
    case when m.closes < 26 then null when w.sig is null then {_MACD} else w.sig * 0.8 + 0.2 * ({_MACD}) end, w.signals + case when m.closes >= 26 then 1 else 0 end
  from walk w join moves m on m.symbol = w.symbol and m.n = w.n + 1),
flows as (select *, case when n = 1 then case when close is not null and volume is not null then 0.0 end else sign(diff) * volume end as flow from moves),
rolled as (
  select *, avg(close) over w20 as a20, avg(close) over w50 as a50, stddev_samp(simple_return) over w20 as vol, stddev_pop(close) over w20 as spread, avg(true_range) over w14 as atr, avg(volume) over w20 as v20, sum(flow) over w as obv,
    count(close) over w20 as c20, count(close) over w50 as c50, count(simple_return) over w20 as r20, count(true_range) over w14 as t14, count(volume) over w20 as n20, count(flow) over w as flowed
  from flows window w as (partition by symbol order by date), w20 as (partition by symbol order by date rows 19 preceding), w50 as (partition by symbol order by date rows 49 preceding), w14 as (partition by symbol order by date rows 13 preceding)),
features as (
  select r.symbol, r.date, r.open, r.high, r.low, r.close, r.volume, r.previous_close, r.simple_return, r.log_return, r.high_low_range, r.open_close_return,
    case when r20 = 20 then vol end as rolling_volatility_20, case when c20 = 20 then a20 end as sma_20, case when c50 = 50 then a50 end as sma_50, case when closes >= 20 then e20 end as ema_20, case when closes >= 50 then e50 end as ema_50,
    case when diffs >= 14 then case when l = 0 and g > 0 then 100 when l = 0 then 50 else 100 - 100 / (1 + g / l) end end as rsi_14,
    case when closes >= 26 then e12 - e26 end as macd, case when signals >= 9 then sig end as macd_signal, case when signals >= 9 then e12 - e26 - sig end as macd_histogram,
    case when c20 = 20 then a20 end as bollinger_middle, case when c20 = 20 then a20 + 2 * spread end as bollinger_upper, case when c20 = 20 then a20 - 2 * spread end as bollinger_lower,
    r.true_range, case when t14 = 14 then atr end as atr_14, case when flowed = r.n then r.obv end as obv, case when n20 = 20 then v20 end as volume_ma_20, r.n <= 49 as is_warmup
  from rolled r join walk using (symbol, n))"""
FEATURES = f"{BARS},{WALK}"

#: Queries and the columns they show.
SHOWN = {
    "lag_returns": ("previous_close", "simple_return"),
    "log_returns": ("log_return",),
    "price_ranges": ("high_low_range", "open_close_return"),
    "rolling_volatility": ("rolling_volatility_20",),
    "sma": ("sma_20", "sma_50"),
    "ema": ("ema_20", "ema_50"),
    "rsi": ("rsi_14",),
    "macd": ("macd", "macd_signal", "macd_histogram"),
    "bollinger": ("bollinger_middle", "bollinger_upper", "bollinger_lower"),
    "true_range_atr": ("true_range", "atr_14"),
    "obv": ("obv",),
    "volume_ma": ("volume_ma_20",),
    "features_full": indicators.FEATURES,
}


def rounded(c: str) -> Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


def _features(spark: SparkSession, d: str, wanted: tuple[str, ...] = indicators.FEATURES) -> DataFrame:
    return indicators.calculate_features(series_bars(spark, d), wanted)


def _show(columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _features(spark, d, columns).select("symbol", "date", *[rounded(c) for c in columns])


def _rounds(columns: tuple[str, ...]) -> str:
    return ", ".join(f"round(cast({c} as double), 6) as {c}" for c in columns)


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return series_bars(spark, d)


def warmup_flag(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, ()).select("symbol", "date", "is_warmup")


def usable_rows(spark: SparkSession, d: str) -> DataFrame:
    return indicators.usable_rows(_features(spark, d)).select("symbol", "date", rounded("close"), rounded("macd_signal"), rounded("sma_50"))


def warmup_counts(spark: SparkSession, d: str) -> DataFrame:
    return indicators.build_metrics(_features(spark, d))


QUERIES = {"daily_bars": daily_bars, **{k: _show(v) for k, v in SHOWN.items()}, "warmup_flag": warmup_flag, "usable_rows": usable_rows, "warmup_counts": warmup_counts}
COMPLETE = " and ".join(f"{c} is not null" for c in indicators.FEATURES if c != "previous_close")
SQL = {
    "daily_bars": f"with {BARS} select * from bars",
    **{k: f"with recursive {FEATURES} select symbol, date, {_rounds(v)} from features" for k, v in SHOWN.items()},
    "warmup_flag": f"with recursive {FEATURES} select symbol, date, is_warmup from features",
    "usable_rows": f"with recursive {FEATURES} select symbol, date, {_rounds(('close', 'macd_signal', 'sma_50'))} from features where not is_warmup and {COMPLETE}",
    "warmup_counts": f"""with recursive {FEATURES}, told as (select *, not is_warmup and {COMPLETE} as usable from features) select count(*) as input_rows, count(*) filter (where usable) as output_rows, count(*) filter (where is_warmup) as warmup_rows_removed, count(*) filter (where not is_warmup and not usable) as missing_rows,
      min(date) filter (where usable) as earliest_date, max(date) filter (where usable) as latest_date, coalesce(string_agg(distinct symbol, ',' order by symbol) filter (where usable), '') as symbols from told""",
}
