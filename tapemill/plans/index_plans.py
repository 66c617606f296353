"""Queries of indices, breadth and health, over index observations and the readings of all feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.operators import indices
from tapemill.plans.indicator_plans import rounded
from tapemill.sources.tables import index_series, series_days, table

SERIES = """
series as (select index_code, date, value, volume, open from index_observations where date is not null qualify row_number() over (partition by index_code, date order by fetched_at desc nulls last, timestamp desc nulls last) = 1)"""
CHANGES = """
day as (select feed, upper(trim(symbol)) as symbol, date, change, volume from market_bars where date is not null qualify row_number() over (partition by feed, upper(trim(symbol)), date order by ingested_at desc nulls last, bar_id desc) = 1)"""
CONTEXT = f"""
{SERIES},
moved as (select *, value / nullif(lag(value) over w, 0) - 1 as r1, value / nullif(lag(value, 5) over w, 0) - 1 as r5 from series window w as (partition by index_code order by date)),
spread as (select *, case when count(r1) over w >= 20 then stddev_pop(r1) over w end as v20 from moved window w as (partition by index_code order by date rows 19 preceding)),
context as (
  select date, max(value) filter (where index_code = 'KSE100') as kse100_value, max(r1) filter (where index_code = 'KSE100') as kse100_return_1d, max(r5) filter (where index_code = 'KSE100') as kse100_return_5d, max(v20) filter (where index_code = 'KSE100') as kse100_volatility_20,
    max(value) filter (where index_code = 'KSE30') as kse30_value, max(r1) filter (where index_code = 'KSE30') as kse30_return_1d, max(value) filter (where index_code = 'KMI30') as kmi30_value, max(r1) filter (where index_code = 'KMI30') as kmi30_return_1d,
    max(value) filter (where index_code = 'ALLSHR') as allshr_value, max(r1) filter (where index_code = 'ALLSHR') as allshr_return_1d from spread group by date)"""
METRICS = f"""
{SERIES},
numbered as (select *, row_number() over (partition by index_code order by date desc) as rn, value / nullif(lag(value) over (partition by index_code order by date), 0) - 1 as r, max(date) over (partition by index_code) as latest from series where value is not null),
wide as (
  select index_code, count(*) as observations, max(date) as latest_date, max(value) filter (where rn = 1) as latest_value, max(value) filter (where rn = 2) as previous_value, max(volume) filter (where rn = 1) as latest_volume,
    max(value) filter (where rn = 6) as v5, max(value) filter (where rn = 22) as v21, max(value) filter (where rn = 64) as v63, max(value) filter (where rn = 127) as v126, max(value) filter (where rn = 253) as v252, arg_min(value, date) as first,
    arg_min(value, date) filter (where date >= date_trunc('year', latest)) as fy, count(*) filter (where date >= date_trunc('year', latest)) as iny, count(r) filter (where rn <= 20) as nr, stddev_pop(r) filter (where rn <= 20) as dev,
    avg(value) filter (where rn <= 20) as a20, avg(value) filter (where rn <= 50) as a50, avg(volume) filter (where rn <= 20) as av from numbered group by 1),
metrics as (
  select index_code, observations, latest_date, latest_value, previous_value, latest_value - previous_value as latest_daily_change, (latest_value / nullif(previous_value, 0) - 1) * 100 as latest_daily_change_percent,
    (latest_value / nullif(v5, 0) - 1) * 100 as one_week_return, (latest_value / nullif(v21, 0) - 1) * 100 as one_month_return, (latest_value / nullif(v63, 0) - 1) * 100 as three_month_return, (latest_value / nullif(v126, 0) - 1) * 100 as six_month_return,
    (latest_value / nullif(v252, 0) - 1) * 100 as one_year_return, (latest_value / nullif(first, 0) - 1) * 100 as maximum_return, case when iny >= 2 then (latest_value / nullif(fy, 0) - 1) * 100 end as year_to_date_return,
    case when nr >= 20 then dev * sqrt(252) * 100 end as rolling_volatility_20, case when observations >= 20 then (latest_value / nullif(a20, 0) - 1) * 100 end as versus_ma_20_percent, case when observations >= 50 then (latest_value / nullif(a50, 0) - 1) * 100 end as versus_ma_50_percent,
    latest_volume, case when observations >= 20 then av end as average_volume_20 from wide)"""
BREADTH = f"""
{CHANGES},
usable as (select * from day where symbol is not null and date is not null and change is not null and volume is not null),
latest as (select feed, max(date) as latest from usable group by 1),
breadth as (
  select feed, max(date) as reference_date, count(*) as universe_size, count(*) filter (where change > 0) as advancing, count(*) filter (where change < 0) as declining, count(*) filter (where change = 0) as unchanged, sum(greatest(volume, 0))::double as total_volume
  from usable join latest using (feed) where date = latest RESTRICT group by 1)"""
SHARES = "case when declining > 0 then advancing / declining when advancing > 0 then 'inf'::double end as advance_decline_ratio, advancing * 100.0 / universe_size as advancing_percent, declining * 100.0 / universe_size as declining_percent, unchanged * 100.0 / universe_size as unchanged_percent"
_c = lambda x: f"case when {x} is not null then greatest(0, least(1, {x})) end"
_POINTS = {
    "1-day direction": "case when latest_daily_change > 0 then 1.0 when latest_daily_change < 0 then 0.0 when latest_daily_change = 0 then 0.5 end",
    "5-trading-day return": _c("0.5 + one_week_return / 20"),
    "20-trading-day return": _c("0.5 + one_month_return / 40"),
    "Value relative to SMA-20": _c("0.5 + versus_ma_20_percent / 20"),
    "Value relative to SMA-50": _c("0.5 + versus_ma_50_percent / 40"),
    "Short-term momentum": _c("0.5 + (one_week_return - one_month_return / 4) / 10"),
    "Rolling volatility penalty": _c("1 - rolling_volatility_20 / 50"),
    "Volume participation": _c("latest_volume / nullif(average_volume_20, 0) / 1.5"),
}
_LABEL = "case when score is null then 'Unavailable' when score < 30 then 'Strongly Bearish' when score < 45 then 'Bearish' when score <= 55 then 'Neutral' when score <= 70 then 'Bullish' else 'Strongly Bullish' end as label"


def _score(points: dict[str, str], weights: dict[str, int]) -> str:
    got = " + ".join(f"coalesce(({points[k]}) * {w}, 0)" for k, w in weights.items())
    used = " + ".join(f"case when ({points[k]}) is null then 0 else {w} end" for k, w in weights.items())
    return f"round_even(({got}) / ({used}) * 100, 1) as score, {used} as available_weight"


def _equity_day(spark: SparkSession, d: str) -> DataFrame:
    return series_days(spark, d).select("feed", "symbol", "date", "change", "volume")


def _universe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registry_updates").where("security_type = 'ordinary_equity'").select(F.upper(F.trim("symbol")).alias("symbol"))


def index_upsert(spark, d):
    return index_series(spark, d).select("index_code", "date", "value", "volume")


def index_change(spark, d):
    return indices.daily_changes(index_series(spark, d)).select("index_code", "date", rounded("daily_change"), rounded("daily_change_percent"))


def index_range_filter(spark, d):
    return indices.range_filter(index_series(spark, d), "6M").select("index_code", "date", "value")


def index_ytd_filter(spark, d):
    return indices.year_to_date(index_series(spark, d)).select("index_code", "date", "value")


def normalized_performance(spark, d):
    return indices.normalized(indices.range_filter(index_series(spark, d), "1Y")).select("index_code", "date", rounded("performance"))


_CONTEXT = ("kse100_value", "kse100_return_1d", "kse100_return_5d", "kse100_volatility_20", "kse30_value", "kse30_return_1d", "kmi30_value", "kmi30_return_1d", "allshr_value", "allshr_return_1d")


def index_context_wide(spark, d):
    return indices.context(index_series(spark, d)).select("date", *[rounded(c) for c in _CONTEXT])


_METRICS = ("latest_value", "previous_value", "latest_daily_change", "latest_daily_change_percent", *indices.LADDER, "maximum_return", "year_to_date_return", "rolling_volatility_20", "versus_ma_20_percent", "versus_ma_50_percent", "latest_volume", "average_volume_20")


def index_metrics(spark, d):
    return indices.metrics(index_series(spark, d)).select("index_code", "observations", "latest_date", *[rounded(c) for c in _METRICS])


def index_returns_ladder(spark, d):
    return index_metrics(spark, d).select("index_code", *indices.LADDER, "maximum_return", "year_to_date_return")


def index_volatility(spark, d):
    return index_metrics(spark, d).select("index_code", "rolling_volatility_20", "versus_ma_20_percent", "versus_ma_50_percent")


def index_health(spark, d):
    return indices.index_health(indices.metrics(index_series(spark, d))).select("index_code", "score", "label", "available_weight")


def index_health_period(spark, d):
    """Health from the last month's rows only, where the longer figures are unavailable."""
    return indices.index_health(indices.metrics(indices.range_filter(index_series(spark, d), "1M"))).select("index_code", "label", "available_weight", "coverage_percentage", F.size("unavailable_components").alias("unavailable"))


def health_comparison(spark, d):
    return indices.health_comparison(indices.index_health(indices.metrics(index_series(spark, d)))).select("index_code", "label", "observation_count")


_BREADTH = ("universe_size", "advancing", "declining", "unchanged", "total_volume")
_SHARES = ("advance_decline_ratio", "advancing_percent", "declining_percent", "unchanged_percent")


_FEED = ("feed",)


def market_breadth(spark, d):
    """Of each feed on its own latest date."""
    return indices.breadth(_equity_day(spark, d), by=_FEED).select("feed", "reference_date", *_BREADTH, *[rounded(c) for c in _SHARES])


def breadth_restricted(spark, d):
    return indices.breadth(_equity_day(spark, d), _universe(spark, d), by=_FEED).select("feed", "reference_date", *_BREADTH)


def market_breadth_by_date(spark, d):
    return indices.breadth(_equity_day(spark, d), by_date=True, by=_FEED).select("feed", "reference_date", *_BREADTH, *[rounded(c) for c in _SHARES])


def market_health(spark, d):
    return indices.market_health(indices.metrics(index_series(spark, d)), indices.breadth(_equity_day(spark, d), by=_FEED), _FEED).select("feed", "score", "label", "available_weight", "reference_date")


def period_summary(spark, d):
    return indices.period_summary(indices.range_filter(index_series(spark, d), "3M"), "index_code", "value", "volume").select("index_code", "first", "latest", "high", "low", "days", "total_volume", rounded("period_return"))


def context_exact_join(spark, d):
    return indices.join_context(_equity_day(spark, d), indices.context(index_series(spark, d))).select("feed", "symbol", "date", rounded("kse100_value"), rounded("kse100_return_1d"), rounded("allshr_value"))


def context_asof_join(spark, d):
    return indices.join_context(_equity_day(spark, d), indices.context(index_series(spark, d)), 3).select("feed", "symbol", "date", "context_date", rounded("kse100_value"), rounded("allshr_value"))


def single_index(spark, d):
    return indices.single_index(indices.range_filter(index_series(spark, d), "1Y"), "KSE100", "KSE-100")


def _r(*columns: str) -> str:
    return ", ".join(f"round(cast({c} as double), 6) as {c}" for c in columns)


_ORDINARY = "and symbol in (select upper(trim(symbol)) from registry_updates where security_type = 'ordinary_equity')"
_PICK = BREADTH.replace("RESTRICT", "")
QUERIES = {f.__name__: f for f in (index_upsert, index_change, index_range_filter, index_ytd_filter, normalized_performance, index_context_wide, index_metrics, index_returns_ladder, index_volatility, index_health, index_health_period, health_comparison, market_breadth, breadth_restricted, market_breadth_by_date, market_health, period_summary, context_exact_join, context_asof_join, single_index)}
_INDEX_SCORE = _score(_POINTS, indices.INDEX_WEIGHTS)
_MARKET_POINTS = {
    "KSE100 trend": "t1", "KSE30 trend": "t2", "KMI30 trend": "t3", "All Share trend": "t4", "Advance/decline ratio": "case when advance_decline_ratio is not null then least(1, advance_decline_ratio / 2) end", "Advancing securities": "case when advancing_percent is not null then least(1, advancing_percent / 70) end",
    "Volume participation": "case when vol is not null then least(1, vol) end", "Moving-average position": "above", "Volatility penalty": "case when dev is not null then greatest(0, 1 - dev / 50) end",
}
_trend = lambda code: _c(f"0.5 + max(one_month_return) filter (where index_code = '{code}') / 20")
SQL = {
    "index_upsert": f"with {SERIES} select index_code, date, value, volume from series",
    "index_change": f"with {SERIES} select index_code, date, round(value - lag(value) over w, 6) as daily_change, round((value - lag(value) over w) / nullif(lag(value) over w, 0) * 100, 6) as daily_change_percent from series window w as (partition by index_code order by date)",
    "index_range_filter": f"with {SERIES} select index_code, date, value from series where date >= (select max(date) from series) - interval 6 month",
    "index_ytd_filter": f"with {SERIES} select index_code, date, value from series where date >= date_trunc('year', (select max(date) from series))",
    "normalized_performance": f"with {SERIES} select index_code, date, round(value / first(value) over (partition by index_code order by date) * 100, 6) as performance from series where date >= (select max(date) from series) - interval 1 year and value is not null",
    "index_context_wide": f"with {CONTEXT} select date, {_r(*_CONTEXT)} from context",
    "index_metrics": f"with {METRICS} select index_code, observations, latest_date, {_r(*_METRICS)} from metrics",
    "index_returns_ladder": f"with {METRICS} select index_code, {_r(*indices.LADDER, 'maximum_return', 'year_to_date_return')} from metrics",
    "index_volatility": f"with {METRICS} select index_code, {_r('rolling_volatility_20', 'versus_ma_20_percent', 'versus_ma_50_percent')} from metrics",
    "index_health": f"with {METRICS}, scored as (select index_code, {_INDEX_SCORE} from metrics) select index_code, score, {_LABEL}, available_weight from scored",
    "index_health_period": f"with {METRICS.replace('from series where value', 'from series where date >= (select max(date) from series) - interval 1 month and value')}, scored as (select index_code, {_INDEX_SCORE}, {' + '.join(f'case when ({p}) is null then 1 else 0 end' for p in _POINTS.values())} as unavailable from metrics) select index_code, {_LABEL}, available_weight, round_even(available_weight::double, 1) as coverage_percentage, unavailable from scored",
    "health_comparison": f"with {METRICS}, scored as (select index_code, {_INDEX_SCORE}, observations from metrics), known(index_code) as (values ('KSE100'), ('KSE30'), ('KMI30'), ('ALLSHR')) select index_code, {_LABEL}, coalesce(observations, 0) as observation_count from known left join scored using (index_code)",
    "market_breadth": f"with {_PICK} select feed, reference_date, {', '.join(_BREADTH)}, {', '.join(f'round({c}, 6) as {c}' for c in _SHARES)} from (select *, {SHARES} from breadth)",
    "breadth_restricted": f"with {BREADTH.replace('RESTRICT', _ORDINARY)} select feed, reference_date, {', '.join(_BREADTH)} from breadth",
    "market_breadth_by_date": f"with {_PICK}, per as (select feed, date as reference_date, count(*) as universe_size, count(*) filter (where change > 0) as advancing, count(*) filter (where change < 0) as declining, count(*) filter (where change = 0) as unchanged, sum(greatest(volume, 0))::double as total_volume from usable group by 1, 2) select feed, reference_date, {', '.join(_BREADTH)}, {', '.join(f'round({c}, 6) as {c}' for c in _SHARES)} from (select *, {SHARES} from per)",
    "market_health": f"with {METRICS}, {_PICK}, one as (select {_trend('KSE100')} as t1, {_trend('KSE30')} as t2, {_trend('KMI30')} as t3, {_trend('ALLSHR')} as t4, avg(latest_volume / nullif(average_volume_20, 0)) as vol, avg(case when versus_ma_20_percent > 0 then 1.0 when versus_ma_20_percent is not null then 0.0 end) as above, avg(rolling_volatility_20) as dev from metrics), scored as (select {_score(_MARKET_POINTS, indices.MARKET_WEIGHTS)}, feed, reference_date from one, (select *, {SHARES} from breadth)) select feed, score, {_LABEL}, available_weight, reference_date from scored",
    "period_summary": f"with {SERIES}, part as (select * from series where date >= (select max(date) from series) - interval 3 month) select index_code, arg_min(value, date) as first, arg_max(value, date) as latest, max(value) as high, min(value) as low, count(distinct date) as days, sum(volume)::bigint as total_volume, round((arg_max(value, date) / arg_min(value, date) - 1) * 100, 6) as period_return from part group by 1",
    "context_exact_join": f"with {CONTEXT}, {CHANGES} select feed, symbol, date, {_r('kse100_value', 'kse100_return_1d', 'allshr_value')} from day left join context using (date)",
    "context_asof_join": f"with {CONTEXT}, {CHANGES} select feed, symbol, d.date, case when d.date - c.date <= 3 then c.date end as context_date, case when d.date - c.date <= 3 then round(kse100_value, 6) end as kse100_value, case when d.date - c.date <= 3 then round(allshr_value, 6) end as allshr_value from day d asof left join context c on d.date >= c.date",
    "single_index": f"with {SERIES} select date, 'KSE-100' as index, value from series where index_code = 'KSE100' and date >= (select max(date) from series) - interval 1 year and value is not null",
}
