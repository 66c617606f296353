"""Queries of dataset builds, splits, scaling, readiness and model status, over the valid readings of every series, with
their SQL.

A series, feed and symbol, is the dataset's symbol and has its symbol's place in the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.operators import datasets, indicators, indices
from tapemill.plans import index_plans, registry_plans
from tapemill.plans.indicator_plans import COMPLETE, DAYS, WALK, rounded
from tapemill.session import durable
from tapemill.sources.tables import all_bars, index_series, named_series, sound_bars

#: Least rows of a symbol's dataset in the queries. With the operators' default of 252 the tables of scale 0.01, over which SQL is
#: compared, have none of an active ordinary equity.
LEAST = 100
TOLERANCE_DAYS = 3
SCALED = tuple(c for c in indicators.FEATURES if c in datasets.COLUMNS)


def _names(spark: SparkSession, d: str) -> DataFrame:
    """(symbol of the series, plain symbol) of all series."""
    return named_series(all_bars(spark, d).select("feed", "symbol", F.col("symbol").alias("plain")).distinct()).select("symbol", "plain")


def series_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry's rows under each series of their symbol."""
    reg = registry_plans.merged(spark, d).withColumnRenamed("symbol", "plain")
    return _names(spark, d).join(reg, "plain").select("symbol", "company_name", "officially_listed", "activity_status", "official_status", "lifecycle_status", "security_type", "is_new_listing")


def series_models(spark: SparkSession, d: str) -> DataFrame:
    """The model records, those of a symbol under each of its series."""
    m = registry_plans.models(spark, d)
    own = m.where("model_scope = 'symbol'").withColumnRenamed("symbol", "plain").join(_names(spark, d), "plain").drop("plain")
    return own.unionByName(m.where("model_scope = 'master'").withColumn("symbol", F.lit(None).cast("string")))


def _sound(spark, d):
    """The valid readings, kept: faults, features and counts look at them."""
    return durable(sound_bars(spark, d))


def _features(spark, d, sound=None):
    return datasets.prepared(_sound(spark, d) if sound is None else sound, series_registry(spark, d))


def _master(spark, d):
    return datasets.master_dataset(_features(spark, d))


def _built(spark, d):
    return datasets.symbol_datasets(_features(spark, d), LEAST)


def metadata_join(spark, d):
    return _features(spark, d).groupBy("symbol", "is_active", "security_type", "lifecycle_status").agg(F.count("*").alias("rows"))


def dataset_with_context(spark, d):
    """The master dataset with all its columns, the market's context at most three days old."""
    rows = datasets.prepared(_sound(spark, d), series_registry(spark, d), indices.context(index_series(spark, d)), TOLERANCE_DAYS)
    numbers = (*SCALED, *indices.CONTEXT)
    return datasets.dataset_rows(datasets.master_dataset(rows)).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in numbers})


def symbol_datasets(spark, d):
    return _built(spark, d).select("symbol", "date", rounded("close"), rounded("sma_20"))


def skipped_symbols(spark, d):
    features = _flags(spark, d)
    return datasets.skipped_symbols(features, datasets.symbol_datasets(features, LEAST))


def master_dataset(spark, d):
    return _master(spark, d).select("symbol", "date", rounded("close"), "security_type")


def chronological_split(spark, d):
    return datasets.chronological_split(_master(spark, d), "master").select("symbol", "date", "split")


def symbol_split(spark, d):
    return datasets.chronological_split(_built(spark, d), "symbol").select("symbol", "date", "split")


def split_metadata(spark, d):
    return datasets.split_metadata(datasets.chronological_split(_master(spark, d), "master"))


def scaler_fit(spark, d):
    one = datasets.fit_scaler(datasets.chronological_split(_master(spark, d), "master"), SCALED)
    return datasets.scaler_rows(one, SCALED).select("feature", rounded("mean"), rounded("scale"), "training_rows")


def standard_scale(spark, d):
    # The dataset is used twice, to fit and to scale: kept.
    split = durable(datasets.chronological_split(_master(spark, d).select("symbol", "date", *SCALED), "master"))
    return datasets.scale(split, datasets.fit_scaler(split, SCALED), SCALED).select("symbol", "date", "split", *[rounded(c) for c in SCALED])


def symbol_eligibility(spark, d):
    sound = _sound(spark, d)
    return datasets.eligibility(sound, series_registry(spark, d), _features(spark, d, sound), LEAST)


def _flags(spark, d, sound=None):
    """What readiness needs of the features, kept: it is looked at twice, and narrow beside what it is made from."""
    return durable(_features(spark, d, sound).select("symbol", "date", "is_warmup", "is_complete", "is_active", "security_type"))


def _readiness(spark, d):
    sound = _sound(spark, d)
    features = _flags(spark, d, sound)
    return datasets.readiness(sound, series_registry(spark, d), features, datasets.symbol_datasets(features, LEAST), LEAST)


def readiness_report(spark, d):
    return _readiness(spark, d)


def readiness_counts(spark, d):
    return _readiness(spark, d).groupBy("readiness_status").agg(F.count("*").alias("symbols"))


def _status(spark, d):
    return datasets.symbol_status(sound_bars(spark, d), series_registry(spark, d), series_models(spark, d), LEAST)


_SHOWN = ("symbol", "security_type", "is_newly_added", "data_start", "data_end", "usable_rows", "eligible", "model_version", "new_data_days", "needs_retraining", "training_status")


def status_table(spark, d):
    return _status(spark, d).select(*_SHOWN)


def combined_status(spark, d):
    return datasets.combined_status(_status(spark, d), _readiness(spark, d)).select("symbol", "usable_rows", "training_status", "readiness_status")


def new_trading_days(spark, d):
    return datasets.new_days(sound_bars(spark, d), datasets.latest_models(series_models(spark, d).where("model_scope = 'symbol'")))


def master_model_status(spark, d):
    return datasets.master_status(_master(spark, d), series_models(spark, d))


def complete_history(spark, d):
    return datasets.complete_history(_master(spark, d))


def model_filter(spark, d):
    return datasets.select_models(_status(spark, d), search="i", types=["ordinary_equity"], states=["retraining_recommended", "up_to_date"]).select("symbol", "training_status")


def bulk_select(spark, d):
    parts = [datasets.bulk_select(_status(spark, d), name).select(F.lit(name).alias("selector"), "symbol") for name in datasets.SELECTORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {f.__name__: f for f in (metadata_join, dataset_with_context, symbol_datasets, skipped_symbols, master_dataset, chronological_split, symbol_split, split_metadata, scaler_fit, standard_scale, symbol_eligibility, readiness_report, readiness_counts, status_table, combined_status, new_trading_days, master_model_status, complete_history, model_filter, bulk_select)}

_TYPES = ", ".join(f"'{t}'" for t in datasets.MASTER_TYPES)
_BASE = f"""
{DAYS}, {registry_plans.FINAL},
names as (select distinct coalesce(feed, '\\N') || '/' || coalesce(upper(trim(symbol)), '\\N') as symbol, upper(trim(symbol)) as plain from market_bars),
reg as (select n.symbol, f.company_name, f.officially_listed, f.activity_status, f.official_status, f.lifecycle_status, f.security_type, f.is_new_listing, f.officially_listed and f.activity_status = 'recently_traded' as is_active from names n join final f on f.symbol = n.plain),
{registry_plans._MODELS.replace("models as", "plain_models as")},
models as (select m.* exclude symbol, n.symbol from plain_models m join names n on n.plain = m.symbol where model_scope = 'symbol' union all select m.* exclude symbol, null from plain_models m where model_scope = 'master'),
latest as (select * from models qualify row_number() over (partition by model_scope, symbol order by model_version desc nulls last, model_id desc) = 1),
sound as (
  select coalesce(feed, '\\N') || '/' || coalesce(symbol, '\\N') as symbol, date, open, high, low, close, volume from force
  where ldcp is not null and open is not null and high is not null and low is not null and close is not null and change is not null and change_percent is not null and volume is not null and high >= low and volume >= 0),
faulty as (select symbol from sound group by 1 having bool_or(open <= 0 or high <= 0 or low <= 0 or close <= 0)),
bars as (select * from sound where symbol not in (select symbol from faulty))"""
USABLE = f"""
{_BASE}, {WALK},
attached as (
  select f.*, {COMPLETE} as is_complete, coalesce(r.is_active, false) as is_active, coalesce(r.official_status, 'unknown') as official_status, coalesce(r.lifecycle_status, 'unknown') as lifecycle_status, coalesce(r.security_type, 'unknown') as security_type
  from features f left join reg r using (symbol)),
usable as (select * from attached where not is_warmup and is_complete),
ordinary as (select * from usable where is_active and security_type = 'ordinary_equity'),
built as (select * from ordinary where symbol in (select symbol from ordinary group by 1 having count(*) >= {LEAST})),
master as (select * from usable where security_type in ({_TYPES}))"""


def _split(source: str, by_symbol: bool) -> str:
    part = "partition by symbol" if by_symbol else ""
    keys = "symbol, date" if by_symbol else "date"
    return f"""
dates as (select *, row_number() over ({part} order by date) as k, count(*) over ({part}) as m from (select distinct {keys} from {source})),
sized as (select *, greatest(1, floor(m * 0.7::double)::int) as t, greatest(1, floor(m * 0.15::double)::int) as v from dates),
parts as (select {keys}, case when m < 3 then null when k <= case when t + v >= m then m - 2 else t end then 'train' when k <= case when t + v >= m then m - 1 else t + v end then 'validation' else 'test' end as split from sized),
split as (select s.*, p.split from {source} s join parts p using ({keys}))"""


_MASTER, _SYMBOL = _split("master", False), _split("built", True)
_RAW = "raw as (select symbol, count(*) as n, min(date) as lo, max(date) as hi from sound group by 1)"
_STATE = f"""
days as (select b.symbol, count(distinct case when b.date > l.training_data_end then b.date end) as new_data_days from sound b join latest l on l.model_scope = 'symbol' and l.symbol = b.symbol group by 1),
{_RAW.replace("raw as", "raws as")},
state as (select *, case when errors then 'data_quality_issue' when security_type <> 'ordinary_equity' then 'unsupported_security_type' when usable_rows < {LEAST} then 'insufficient_history' when model_version is null or model_status = 'not_trained' then 'never_trained' when model_status = 'failed' then 'training_failed'
    when new_data_days > 0 then 'retraining_recommended' else 'up_to_date' end as training_status, not errors and security_type = 'ordinary_equity' and usable_rows >= {LEAST} as eligible
  from (select r.symbol, r.company_name, r.security_type, r.is_new_listing as is_newly_added, w.lo as data_start, w.hi as data_end, greatest(0, coalesce(w.n, 0) - 49) as usable_rows, l.model_version, l.model_status, coalesce(y.new_data_days, 0) as new_data_days, coalesce(y.new_data_days, 0) > 0 as needs_retraining, r.symbol in (select symbol from faulty) as errors
    from reg r left join raws w using (symbol) left join latest l on l.model_scope = 'symbol' and l.symbol = r.symbol left join days y on y.symbol = r.symbol where r.is_active))"""
_READY = f"""
{_SYMBOL}, {_RAW},
sizes as (select symbol, count(*) filter (where split = 'train') as a, count(*) filter (where split = 'validation') as b, count(*) filter (where split = 'test') as c from split group by 1),
made as (select symbol, count(*) filter (where is_warmup) as warm, count(*) filter (where not is_warmup and is_complete) as usable from attached group by 1),
counted as (select r.symbol, r.company_name, r.security_type, coalesce(w.n, 0) as raw_trading_rows, w.lo as earliest_raw_date, w.hi as latest_raw_date, coalesce(m.warm, 0) as warmup_rows_removed, coalesce(m.usable, 0) as usable_feature_rows, s.symbol is null as lost, a, b, c
  from reg r left join raw w using (symbol) left join made m using (symbol) left join sizes s using (symbol) where r.is_active),
ready as (select *, case when symbol in (select symbol from faulty) then 'Data Quality Issue' when security_type <> 'ordinary_equity' then 'Unsupported Security Type' when usable_feature_rows < {LEAST} then 'Insufficient History' when lost then 'Missing Processed Dataset' when c = 0 then 'Data Quality Issue' else 'Ready' end as readiness_status from counted)"""
_MEANS = "stats as (" + " union all ".join(f"select '{c}' as feature, count(*) as training_rows, avg({c}) as mean, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as scale from split where split = 'train'" for c in SCALED) + ")"
_WIDE = "wide as (select " + ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as s_{c}" for c in SCALED) + " from split where split = 'train')"
_CONTEXT = index_plans.CONTEXT.replace("moved as", "shifted as").replace("from moved", "from shifted").replace("spread as", "volatile as").replace("from spread", "from volatile")
_r = lambda columns: ", ".join(f"round(cast({c} as double), 6) as {c}" for c in columns)
_WITH = f"with recursive {USABLE}"
_KNOWN = tuple(c for c in indices.CONTEXT if not c.startswith("market_"))
SQL = {
    "metadata_join": f"{_WITH} select symbol, is_active, security_type, lifecycle_status, count(*) as rows from attached group by all",
    "dataset_with_context": f"{_WITH}, {_CONTEXT} select m.symbol, m.date, {_r(f'm.{c}' for c in SCALED).replace(' as m.', ' as ')}, {', '.join(datasets.METADATA)}, {', '.join(f'case when m.date - x.date <= {TOLERANCE_DAYS} then round(cast({c} as double), 6) end as {c}' for c in _KNOWN)}, {', '.join(f'null::double as {c}' for c in indices.CONTEXT if c not in _KNOWN)}, '{datasets.VERSION}' as feature_version from master m asof left join context x on m.date >= x.date",
    "symbol_datasets": f"{_WITH} select symbol, date, {_r(('close', 'sma_20'))} from built",
    "skipped_symbols": f"{_WITH} select distinct symbol from bars where symbol not in (select symbol from built)",
    "master_dataset": f"{_WITH} select symbol, date, {_r(('close',))}, security_type from master",
    "chronological_split": f"{_WITH}, {_MASTER} select symbol, date, split from split",
    "symbol_split": f"{_WITH}, {_SYMBOL} select symbol, date, split from split",
    "split_metadata": f"{_WITH}, {_MASTER} select split, min(date) as start_date, max(date) as end_date, count(*) as rows, string_agg(distinct symbol, ',' order by symbol) as symbols from split where split is not null group by 1",
    "scaler_fit": f"{_WITH}, {_MASTER}, {_MEANS} select feature, round(mean, 6) as mean, round(scale, 6) as scale, training_rows from stats",
    "standard_scale": f"{_WITH}, {_MASTER}, {_WIDE} select symbol, date, split, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) as {c}' for c in SCALED)} from split, wide",
    "symbol_eligibility": f"{_WITH}, per as (select s.symbol, s.symbol in (select symbol from faulty) as bad, coalesce(r.is_active, false) as act, coalesce(r.security_type, 'unknown') as kind, coalesce(u.n, 0) as usable_rows from (select distinct symbol from sound) s left join reg r using (symbol) left join (select symbol, count(*) as n from usable group by 1) u using (symbol)) select symbol, usable_rows, not bad and act and kind = 'ordinary_equity' and usable_rows >= {LEAST} as eligible, case when bad then 'data_quality_issue' when not act then 'inactive' when kind <> 'ordinary_equity' then 'unsupported_security_type' when usable_rows < {LEAST} then 'insufficient_history' else '' end as reason from per",
    "readiness_report": f"{_WITH}, {_READY} select symbol, company_name, raw_trading_rows, earliest_raw_date, latest_raw_date, warmup_rows_removed, usable_feature_rows, {LEAST} as minimum_usable_rows, greatest(0, {LEAST} - usable_feature_rows) as additional_rows_required, case when readiness_status = 'Ready' then a else 0 end as train_rows, case when readiness_status = 'Ready' then b else 0 end as validation_rows, case when readiness_status = 'Ready' then c else 0 end as test_rows, readiness_status from ready",
    "readiness_counts": f"{_WITH}, {_READY} select readiness_status, count(*) as symbols from ready group by 1",
    "status_table": f"{_WITH}, {_STATE} select {', '.join(_SHOWN)} from state",
    "combined_status": f"{_WITH}, {_STATE}, {_READY} select s.symbol, r.usable_feature_rows as usable_rows, case when r.readiness_status = 'Missing Processed Dataset' then 'missing_processed_dataset' else s.training_status end as training_status, r.readiness_status from state s join ready r using (symbol)",
    "new_trading_days": f"{_WITH}, {_STATE} select symbol, new_data_days from days",
    "master_model_status": f"{_WITH}, last as (select * from latest where model_scope = 'master'), counted as (select (select count(*) from master) as rows, (select max(date) from master) as latest_date, model_version, model_status, (select count(distinct date) from master where date > training_data_end) as new_data_days from last) select *, case when rows = 0 then 'missing_processed_dataset' when model_version is null or model_status = 'not_trained' then 'never_trained' when model_status = 'failed' then 'training_failed' when new_data_days > 0 then 'retraining_recommended' else 'up_to_date' end as training_status from counted",
    "complete_history": f"{_WITH} select symbol, min(date) as training_data_start, max(date) as training_data_end, count(*) as training_rows from master group by 1",
    "model_filter": f"{_WITH}, {_STATE} select symbol, training_status from state where (contains(lower(symbol), 'i') or contains(lower(company_name), 'i')) and security_type = 'ordinary_equity' and training_status in ('retraining_recommended', 'up_to_date')",
    "bulk_select": f"{_WITH}, {_STATE} select 'active_eligible' as selector, symbol from state where eligible union all select 'new_eligible', symbol from state where is_newly_added and eligible union all select 'needs_retraining', symbol from state where needs_retraining and eligible union all select 'never_trained', symbol from state where training_status = 'never_trained' and eligible union all select 'visible', symbol from state",
}
