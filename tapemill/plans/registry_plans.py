"""Queries of deduplication, validation, the registry and its filters, over all feeds and listings, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.functions.text import reported, symbol_key
from tapemill.operators import dedup, quality, registry
from tapemill.sources.tables import SERIES, all_bars, table

REFERENCE = date(2026, 7, 31)
_N = "nullif(replace(replace(lower(trim({0})), ' ', '_'), '-', '_'), '')"
_SQUEEZE = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
LISTINGS = f"""
listings as (
  select upper(trim(symbol)) as symbol, company_name, {_N.format('security_type')} as security_type, sector, board, listing_segment, officially_listed, {_N.format('official_status')} as official_status, source, shares
  from registry_updates qualify row_number() over (partition by upper(trim(symbol)) order by received_at desc, update_id desc) = 1),
history as (select upper(trim(symbol)) as symbol, min(date) as first_seen_date, max(date) as last_seen_date, count(distinct date) as trading_days from market_bars where date is not null and trim(symbol) <> '' group by 1)"""
REGISTRY = f"""
{LISTINGS},
joined as (select coalesce(k.symbol, h.symbol) as symbol, k.* exclude symbol, h.* exclude symbol, coalesce(officially_listed, false) as listed from listings k full join history h on k.symbol = h.symbol),
aged as (select *, greatest(0, date_diff('day', last_seen_date, date '2026-07-31')) as age, greatest(0, date_diff('day', first_seen_date, date '2026-07-31')) as young from joined),
merged as (
  select symbol, {_SQUEEZE.format('company_name')} as company_name, {_SQUEEZE.format('sector')} as sector, listed as officially_listed, first_seen_date, last_seen_date, coalesce(trading_days, 0) as trading_days, shares,
    case when listed then coalesce(official_status, 'unknown') else 'historical' end as official_status, case when listed then {_SQUEEZE.format('source')} else 'master_market_history' end as source,
    case when listed then coalesce(security_type, 'unknown') when regexp_matches(symbol, '{registry.LISTED_IN_MONTH}') then 'other' else 'unknown' end as security_type,
    case when last_seen_date is null then null else age::int end as days_since_last_seen,
    case when last_seen_date is null then 'never_seen_in_market_history' when age <= 30 then 'recently_traded' else 'not_recently_traded' end as activity_status,
    listed and first_seen_date is not null and young <= 30 as is_new_listing, '' as notes from aged)"""
_LIFE = "case when official_status = 'delisted' then 'officially_delisted' when official_status = 'suspended' then 'suspended' when official_status = 'non_compliant' then 'non_compliant' when is_new_listing and officially_listed then 'newly_listed' when officially_listed and activity_status = 'recently_traded' then 'listed_recently_traded' when officially_listed then 'listed_not_recently_traded' when official_status = 'historical' then 'historical_only' else 'unknown' end as lifecycle_status"
FINAL = f"{REGISTRY}, final as (select *, {_LIFE} from merged)"


def listings(spark: SparkSession, d: str) -> DataFrame:
    """The last report of each symbol."""
    rows = table(spark, d, "registry_updates").withColumn("symbol", symbol_key("symbol"))
    return dedup.keep_last(rows, ["symbol"], ["received_at", "update_id"]).select("symbol", "company_name", reported("security_type").alias("security_type"), "sector", "board", "listing_segment", "officially_listed", reported("official_status").alias("official_status"), "source", F.lit("").alias("non_compliance_reason"), "shares")


def merged(spark: SparkSession, d: str) -> DataFrame:
    return registry.merge(listings(spark, d), registry.history_ranges(all_bars(spark, d)), REFERENCE)


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """An override of every listed symbol, made from its share count."""
    text = lambda x: F.lit(x)
    return listings(spark, d).select("symbol", F.concat("company_name", text(" (renamed)")).alias("company_name_override"), F.when(F.col("shares") % 2 == 0, "suspended").alias("official_status_override"), text("").alias("previous_symbol"), text("NEXT").alias("successor_symbol"), text(None).cast("string").alias("corporate_action_type"), text("by  hand").alias("notes"))


def models(spark: SparkSession, d: str) -> DataFrame:
    """Model records made from the dataset builds."""
    b = table(spark, d, "dataset_builds")
    status = F.element_at(F.array(*map(F.lit, ("not_trained", "failed", "trained", "trained"))), (F.col("build_id") % 4 + 1).cast("int"))
    return b.select(F.col("build_id").alias("model_id"), F.when(F.col("build_id") % 10 == 0, "master").otherwise("symbol").alias("model_scope"), symbol_key("symbol").alias("symbol"), F.col("output_rows").alias("model_version"), status.alias("model_status"), F.col("latest_date").alias("training_data_end"))


def master_dedup(spark, d):
    return dedup.keep_last(all_bars(spark, d), SERIES, ["ingested_at", "bar_id"]).select("feed", "symbol", "date", "close", "volume", "bar_id")


def duplicate_count(spark, d):
    return dedup.duplicate_count(all_bars(spark, d), SERIES)


def conflict_report(spark, d):
    return dedup.conflicts(all_bars(spark, d), SERIES, ["open", "high", "low", "close", "volume"], "ingested_at", "load_id").select("feed", "symbol", "date", "versions", "payloads")


def payload_dedup(spark, d):
    """Of a code's observations on a date the greatest timestamp, then the earliest position."""
    rows = table(spark, d, "index_observations").withColumn("_back", -F.unix_micros(F.col("fetched_at").cast("timestamp")))
    return dedup.keep_last(rows, ["index_code", "date"], ["timestamp", "_back"]).select("index_code", "date", "timestamp", "fetched_at")


def status_priority_dedup(spark, d):
    rows = table(spark, d, "registry_updates").withColumns({"symbol": symbol_key("symbol"), "official_status": reported("official_status")})
    return dedup.by_priority(rows, ["symbol"], "official_status", {"listed": 0, "non_compliant": 1}, ["update_id"]).select("symbol", "official_status", "update_id")


def latest_version(spark, d):
    return dedup.keep_last(models(spark, d), ["model_scope", "symbol"], ["model_version", "model_id"])


def next_version(spark, d):
    return dedup.next_versions(models(spark, d))


def record_validation(spark, d):
    rows = all_bars(spark, d)
    return rows.select("bar_id", quality.validation_reasons(rows).alias("reason"))


def valid_counts(spark, d):
    good, bad = quality.validate(all_bars(spark, d))
    return good.agg(F.count("*").alias("rows")).select(F.lit("valid").alias("kind"), "rows").unionByName(bad.agg(F.count("*").alias("rows")).select(F.lit("rejected").alias("kind"), "rows"))


def quality_errors(spark, d):
    return quality.fatal_errors(all_bars(spark, d), ("feed",))


def dataset_validation(spark, d):
    return quality.dataset_summary(all_bars(spark, d), ("symbol", "date", "close", "feature_version"))


def history_ranges(spark, d):
    return registry.history_ranges(all_bars(spark, d))


_SHOWN = ("symbol", "company_name", "sector", "officially_listed", "official_status", "source", "security_type", "trading_days", "days_since_last_seen", "activity_status", "is_new_listing", "lifecycle_status")


def registry_outer_merge(spark, d):
    return merged(spark, d).select(*_SHOWN)


def lifecycle_status(spark, d):
    return merged(spark, d).groupBy("lifecycle_status").agg(F.count("*").alias("symbols"))


def activity_status(spark, d):
    return merged(spark, d).groupBy("activity_status", "is_new_listing").agg(F.count("*").alias("symbols"), F.max("days_since_last_seen").alias("oldest"))


def override_merge(spark, d):
    return registry.override(merged(spark, d), overrides(spark, d), check=False).select("symbol", "company_name", "official_status", "successor_symbol", "notes", "source", "lifecycle_status")


def unknown_overrides_anti(spark, d):
    """Overridden symbols that no feed ever traded."""
    return registry.unknown_overrides(registry.history_ranges(all_bars(spark, d)), overrides(spark, d))


def registry_counts(spark, d):
    return registry.counts(merged(spark, d))


def registry_filter(spark, d):
    return registry.select_rows(merged(spark, d), {"security_type": ["ordinary_equity", "etf"], "sector": []}, listed_only=True, search="LI", least_days=20).select("symbol", "company_name", "security_type", "trading_days")


def semi_restrict(spark, d):
    return registry.restrict(all_bars(spark, d), registry.select_rows(merged(spark, d), ordinary_only=True)).groupBy("feed", "symbol").agg(F.count("*").alias("rows"))


def training_universe(spark, d):
    return registry.universe(merged(spark, d), ["ordinary_equity"], 60)


def company_summary(spark, d):
    return registry.company_summary(all_bars(spark, d), merged(spark, d), "bar_id", ("feed",)).select("feed", "symbol", "first_date", "last_date", "trading_days", "rows", "latest_close", "company_name", "lifecycle_status")


QUERIES = {f.__name__: f for f in (master_dedup, duplicate_count, conflict_report, payload_dedup, status_priority_dedup, latest_version, next_version, record_validation, valid_counts, quality_errors, dataset_validation, history_ranges, registry_outer_merge, lifecycle_status, activity_status, override_merge, unknown_overrides_anti, registry_counts, registry_filter, semi_restrict, training_universe, company_summary)}

_FEED = "feed as (select * replace (upper(trim(symbol)) as symbol) from market_bars)"
_MODELS = "models as (select build_id as model_id, case when build_id % 10 = 0 then 'master' else 'symbol' end as model_scope, upper(trim(symbol)) as symbol, output_rows as model_version, ['not_trained', 'failed', 'trained', 'trained'][build_id % 4 + 1] as model_status, latest_date as training_data_end from dataset_builds)"
_OVER = "overrides as (select symbol, company_name || ' (renamed)' as name, case when shares % 2 = 0 then 'suspended' end as status from listings)"
_REASON = "concat_ws('; ', " + ", ".join(f"case when {c} is null then '{c} is missing' end" for c in quality.REQUIRED) + ", case when trim(symbol) = '' then 'symbol is empty' end, case when high < low then 'high is lower than low' end, case when volume < 0 then 'volume is negative' end)"
SQL = {
    "master_dedup": f"with {_FEED} select feed, symbol, date, close, volume, bar_id from feed qualify row_number() over (partition by feed, symbol, date order by ingested_at desc, bar_id desc) = 1",
    "duplicate_count": f'with {_FEED} select count(*) as rows, count(distinct (feed, symbol, date)) as distinct_keys, count(*) - count(distinct (feed, symbol, date)) as duplicates from feed',
    "conflict_report": f"with {_FEED} select feed, symbol, date, count(*) as versions, count(distinct (open, high, low, close, volume)) as payloads from feed group by 1, 2, 3 having count(distinct (open, high, low, close, volume)) > 1",
    "payload_dedup": "select index_code, date, timestamp, fetched_at from index_observations qualify row_number() over (partition by index_code, date order by timestamp desc, fetched_at) = 1",
    "status_priority_dedup": f"select upper(trim(symbol)) as symbol, {_N.format('official_status')} as official_status, update_id from registry_updates qualify row_number() over (partition by upper(trim(symbol)) order by case {_N.format('official_status')} when 'listed' then 0 when 'non_compliant' then 1 else -1 end desc, update_id desc) = 1",
    "latest_version": f"with {_MODELS} select * from models qualify row_number() over (partition by model_scope, symbol order by model_version desc, model_id desc) = 1",
    "next_version": f"with {_MODELS} select model_scope, symbol, max(model_version) + 1 as next_version from models group by 1, 2",
    "record_validation": f"with {_FEED} select bar_id, {_REASON} as reason from feed",
    "valid_counts": f"with {_FEED} select case when {_REASON} = '' then 'valid' else 'rejected' end as kind, count(*) as rows from feed group by 1",
    "quality_errors": f"""with {_FEED} select feed, symbol, errors from (select feed, symbol, concat_ws('; ', case when bool_or(date is null) then 'invalid trading date' end, case when bool_or(open is null or high is null or low is null or close is null or volume is null) then 'missing or invalid OHLCV value' end,
      case when count(*) > count(distinct date) then 'duplicate trading date' end, case when bool_or(high < low) then 'high is lower than low' end, case when bool_or(volume < 0) then 'volume is negative' end, case when bool_or(open <= 0 or high <= 0 or low <= 0 or close <= 0) then 'price is not positive' end) as errors from feed group by 1, 2) where errors <> ''""",
    "dataset_validation": f"with {_FEED} select count(*) as rows, count(distinct symbol) as symbols, min(date) as earliest_date, max(date) as latest_date, count(*) filter (where date is null) as invalid_dates, count(*) filter (where coalesce(symbol, '') = '') as blank_symbols, 'feature_version' as missing_columns, false as valid from feed",
    "history_ranges": f"with {LISTINGS} select * from history",
    "registry_outer_merge": f"with {FINAL} select {', '.join(_SHOWN)} from final",
    "lifecycle_status": f"with {FINAL} select lifecycle_status, count(*) as symbols from final group by 1",
    "activity_status": f"with {FINAL} select activity_status, is_new_listing, count(*) as symbols, max(days_since_last_seen)::int as oldest from final group by 1, 2",
    "override_merge": f"""with {REGISTRY}, {_OVER}, over as (select m.* replace (case when o.symbol is not null and trim(coalesce(name, '')) <> '' then {_SQUEEZE.format('name')} else company_name end as company_name, coalesce(o.status, official_status) as official_status,
      case when o.symbol is null then source when source = '' then 'manual_override' else source || '; manual_override' end as source, case when o.symbol is null then '' else 'by hand' end as notes), case when o.symbol is null then '' else 'NEXT' end as successor_symbol from merged m left join overrides o on m.symbol = o.symbol)
      select symbol, company_name, official_status, successor_symbol, notes, source, {_LIFE} from over""",
    "unknown_overrides_anti": f"with {LISTINGS}, {_OVER} select distinct symbol from overrides where symbol not in (select symbol from history)",
    "registry_counts": f"""with {FINAL} select count(*) as total, count(*) filter (where officially_listed) as listed, count(*) filter (where activity_status = 'recently_traded') as recently_traded, count(*) filter (where officially_listed and activity_status <> 'recently_traded') as listed_idle,
      count(*) filter (where is_new_listing) as new_listings, count(*) filter (where lifecycle_status = 'historical_only') as historical_only, count(*) filter (where official_status = 'non_compliant') as non_compliant, count(*) filter (where official_status = 'suspended') as suspended,
      count(*) filter (where official_status = 'delisted') as delisted, count(*) filter (where security_type = 'ordinary_equity') as ordinary_equity from final""",
    "registry_filter": f"with {FINAL} select symbol, company_name, security_type, trading_days from final where security_type in ('ordinary_equity', 'etf') and officially_listed and (contains(lower(symbol), 'li') or contains(lower(company_name), 'li')) and trading_days >= 20",
    "semi_restrict": f"with {FINAL}, {_FEED} select feed, symbol, count(*) as rows from feed where symbol in (select symbol from final where security_type = 'ordinary_equity') group by 1, 2",
    "training_universe": f"with {FINAL} select distinct symbol from final where officially_listed and activity_status = 'recently_traded' and security_type = 'ordinary_equity' and trading_days >= 60",
    "company_summary": f"with {FINAL}, {_FEED}, per as (select feed, symbol, min(date) as first_date, max(date) as last_date, count(distinct date) as trading_days, count(*) as rows from feed group by 1, 2), last as (select feed, symbol, close as latest_close from feed qualify row_number() over (partition by feed, symbol order by date desc, bar_id desc) = 1) select p.feed, p.symbol, p.first_date, p.last_date, p.trading_days, p.rows, latest_close, company_name, lifecycle_status from per p join last using (feed, symbol) left join final f on f.symbol = p.symbol",
}
