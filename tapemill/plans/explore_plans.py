"""Queries of filters, pages, summaries, set operations, calendars, display forms and parsers, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tapemill.functions import display
from tapemill.operators import datasets, explore, indices, planner, registry
from tapemill.plans.indicator_plans import DAYS, rounded
from tapemill.plans.registry_plans import _MODELS, FINAL, merged, models
from tapemill.sources import parsers
from tapemill.sources.tables import all_bars, series_days, table

TODAY = date(2026, 7, 30)
START, END = date(2025, 11, 1), date(2026, 2, 28)


def filter_market(spark, d):
    return explore.filter_market(all_bars(spark, d), "MKTX", START, END).select("bar_id", "feed", "date", "close")


def security_history(spark, d):
    return explore.security_history(all_bars(spark, d), " MKTX ").select("bar_id", "feed", "date", "close")


def period_filter(spark, d):
    return explore.history_period(all_bars(spark, d), 6).select("bar_id", "symbol", "date", "close")


def dataset_summary(spark, d):
    return explore.summary(all_bars(spark, d))


def null_counts(spark, d):
    return explore.null_counts(table(spark, d, "market_bars"))


def history_lengths(spark, d):
    return explore.history_lengths(all_bars(spark, d), ("feed",)).select("symbols", rounded("mean"), rounded("deviation"), "least", "p25", "p50", "p75", "greatest")


def option_lists(spark, d):
    return explore.options(table(spark, d, "registry_updates"), "sector")


def newest_first(spark, d):
    return explore.numbered(all_bars(spark, d).select("bar_id", "symbol", "date", "close"), [F.col("date").desc_nulls_last(), F.col("symbol").asc_nulls_last(), F.col("bar_id")])


def sorted_market(spark, d):
    return explore.numbered(all_bars(spark, d).select("bar_id", "symbol", "date", "close"), [F.col("date").asc_nulls_last(), F.col("symbol").asc_nulls_last(), F.col("bar_id")])


def paginate(spark, d):
    return explore.paginate(all_bars(spark, d).select("bar_id", "symbol", "date", "close"), [F.col("date").desc(), F.col("symbol"), F.col("bar_id")], 25, 3)


def latest_row(spark, d):
    b = series_days(spark, d)
    return b.groupBy("feed", "symbol").agg(F.max_by(F.struct("date", "open", "close", "volume"), "date").alias("r")).select("feed", "symbol", "r.*")


def tail_rows(spark, d):
    return explore.tail(series_days(spark, d), ["feed", "symbol"], [F.col("date").desc()], 20).select("feed", "symbol", "date", "close")


def union_all(spark, d):
    b = all_bars(spark, d)
    return b.where("volume = 0").select("bar_id", "symbol").unionByName(b.where("change = 0").select("symbol", "bar_id"))


def except_dates(spark, d):
    """Dates with bars on which the exchange was not open."""
    return all_bars(spark, d).select("date").subtract(table(spark, d, "trading_calendar").where("is_open").select("date"))


def intersect_dates(spark, d):
    """Dates on which the heaviest symbol and some other were traded."""
    b = all_bars(spark, d)
    return b.where("symbol = 'MKTX'").select("date").intersect(b.where("symbol <> 'MKTX'").select("date"))


def _days(spark, d):
    """Every day of the calendar's span."""
    first, last = table(spark, d, "trading_calendar").agg(F.min("date"), F.max("date")).first()
    return planner.calendar(spark, first, last)


def missing_dates(spark, d):
    return planner.missing_dates(_days(spark, d), table(spark, d, "market_bars"))


def _states(spark, d):
    f = table(spark, d, "fetch_results")
    state = F.when(F.col("status") == "successful", "successful").when(F.col("status").isNull(), "temporary_unavailable").otherwise("failed")
    return planner.latest_states(f.select(F.col("trading_date").alias("date"), F.col("source_file").alias("at"), state.alias("state")))


def state_transition(spark, d):
    return _states(spark, d)


def backfill_plan(spark, d):
    return planner.backfill_plan(_days(spark, d), table(spark, d, "market_bars"), _states(spark, d), TODAY)


def backfill_totals(spark, d):
    return planner.plan_totals(backfill_plan(spark, d), 2.0)


def empty_response_class(spark, d):
    return _days(spark, d).select("date", planner.empty_response(F.col("date"), F.lit(TODAY)).alias("state"))


def calendar_days(spark, d):
    return table(spark, d, "trading_calendar").select("date", (F.weekday("date") >= 5).alias("is_weekend"), F.datediff(F.lit(TODAY), F.col("date")).alias("age_days"))


def security_type_inference(spark, d):
    r = table(spark, d, "registry_updates")
    c = F.col
    return r.select("update_id", registry.security_type(c("symbol"), c("company_name"), c("sector"), c("board")).alias("inferred"), registry.history_type(F.upper(F.trim("symbol"))).alias("from_history"))


def normalize_text(spark, d):
    r = table(spark, d, "registry_updates")
    return r.select("update_id", registry.squeezed(F.col("company_name")).alias("company_name"), F.upper(F.trim("symbol")).alias("symbol"), parsers.header_key(F.col("sector")).alias("header"), registry.noted(F.col("sector"), F.col("board")).alias("note"))


def symbol_labels(spark, d):
    return table(spark, d, "registry_updates").select("update_id", display.security(F.col("symbol"), F.col("company_name")).alias("label"))


def enum_humanize(spark, d):
    r = table(spark, d, "registry_updates")
    return r.select("update_id", display.humanized(F.col("lifecycle_status")).alias("lifecycle"), display.badge(F.col("official_status")).alias("badge"), display.source(F.col("source")).alias("source"))


def volume_abbrev(spark, d):
    b = table(spark, d, "market_bars")
    return b.select("bar_id", display.volume(F.col("volume")).alias("volume"), display.day(F.col("date")).alias("day"), display.integer(F.col("volume")).alias("whole"))


def display_numbers(spark, d):
    """Display forms of prices, moves and times."""
    b = table(spark, d, "market_bars")
    return b.select("bar_id", display.price(F.col("close")).alias("price"), display.directional(F.col("change_percent")).alias("move"), display.instant(F.col("ingested_at")).alias("at"))


def display_times(spark, d):
    """Times with offsets, in the exchange's zone."""
    return table(spark, d, "registry_updates").select("update_id", display.instant_text(F.col("registry_updated_at")).alias("at"))


def display_summary(spark, d):
    """The company summary under its display names."""
    summary = registry.company_summary(all_bars(spark, d), merged(spark, d), "bar_id", ("feed",))
    rows = summary.join(merged(spark, d).select("symbol", "activity_status"), "symbol", "left").withColumnsRenamed({"first_date": "first_seen_date", "last_date": "last_seen_date"})
    return display.company_table(rows, "feed")


def display_models(spark, d):
    """The model records under their display names."""
    m = models(spark, d).withColumns({"last_trained_at": F.lit(None).cast("timestamp_ntz"), "training_data_start": F.lit(None).cast("date"), "new_data_days": F.col("model_version") % 7, "needs_retraining": (F.col("model_id") % 3 == 0).cast("string")})
    return display.model_table(m, "model_id")


def model_ids(spark, d):
    b = table(spark, d, "dataset_builds")
    return b.select("build_id", datasets.model_id(F.lit("symbol"), F.trim("symbol"), F.col("output_rows")).alias("model_id"))


def json_observations(spark, d):
    """Index payloads made from the observations, nulls included, parsed back."""
    o = table(spark, d, "index_observations")
    number = lambda c: F.coalesce(F.col(c).cast("decimal(18,4)").cast("string"), F.lit("null"))
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    point = F.format_string("[%s,%s,%s,%s]", whole("timestamp"), number("value"), whole("volume"), number("open"))
    payload = o.groupBy("index_code", "date").agg(F.format_string('{"status":1,"data":[%s]}', F.array_join(F.sort_array(F.collect_list(point)), ",")).alias("payload"))
    got = parsers.index_points(payload.select("index_code", "payload"), codes=indices.INDEX_CODES)
    return got.select("index_code", "timestamp", "date", rounded("value"), "volume", rounded("open"), "reason")


def html_cells(spark, d):
    """Market pages made from all bars, one for each date, load and feed, parsed back."""
    return parsed_pages(all_bars(spark, d), ["date", "load_id", "feed"])


def parsed_pages(b, keys):
    """Market pages made from the bars, one for each value of ``keys``, which hold the date, parsed back."""
    cell = lambda c, t: F.concat(F.lit('<td data-value="'), F.coalesce(F.col(c).cast(t).cast("string"), F.lit("")), F.lit('">x</td>'))
    row = F.concat(F.lit('<tr data-type="equity"><td>'), F.col("symbol"), F.lit("</td>"), *[cell(c, "decimal(18,4)") for c in parsers.EQUITY[1:-1]], cell("volume", "bigint"), F.lit("</tr>"))
    pages = b.groupBy(*keys).agg(F.concat(F.lit("<table><tr><th>x</th></tr>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    got = parsers.equity_rows(pages.select(F.concat_ws("/", *keys).alias("page_id"), "date", "html"))
    return got.select("page_id", "date", "symbol", rounded("ldcp"), rounded("close"), "volume", "reason")


QUERIES = {f.__name__: f for f in (filter_market, security_history, period_filter, dataset_summary, null_counts, history_lengths, option_lists, newest_first, sorted_market, paginate, latest_row, tail_rows, union_all, except_dates, intersect_dates, missing_dates, state_transition, backfill_plan, backfill_totals, empty_response_class, calendar_days, security_type_inference, normalize_text, symbol_labels, enum_humanize, volume_abbrev, display_numbers, display_times, display_summary, display_models, model_ids, json_observations, html_cells)}

_ALL = "with bars as (select * replace (upper(trim(symbol)) as symbol) from market_bars)"
_DAYS = "days as (select unnest(generate_series((select min(date) from trading_calendar)::timestamp, (select max(date) from trading_calendar)::timestamp, interval 1 day))::date as date)"
_STATES = "states as (select trading_date as date, arg_max(case when status = 'successful' then 'successful' when status is null then 'temporary_unavailable' else 'failed' end, source_file) as state, count(*) as attempts from fetch_results group by 1)"
_PLAN = f"""{_DAYS}, {_STATES}, seen as (select d.date, d.date in (select date from market_bars where date is not null) as there, isodow(d.date) >= 6 as weekend, d.date >= date '{TODAY}' as late, coalesce(s.state, '') as state from days d left join states s using (date)),
plan as (select date, 'existing' as plan from seen where there union all select date, 'weekend' from seen where weekend union all select date, 'unresolved' from seen where not there and (state = 'temporary_unavailable' or (not weekend and late))
  union all select date, 'non_trading' from seen where state = 'non_trading' union all select date, 'failed' from seen where state = 'failed' union all select date, 'request' from seen where not there and not weekend and not late and state not in ('non_trading', 'failed'))"""
_TOLD = "upper(concat_ws(' ', coalesce(company_name, ''), coalesce(sector, '')))"
_MISS = "coalesce(lower(trim({0})) in ('', 'nan', 'nat', 'none', 'null'), true)"
_KEY = "lower(trim({0}))"
_WORDS = "array_to_string(list_transform(string_split(trim(regexp_replace(lower(trim({0})), '[_-]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _human(c: str) -> str:
    labels = " ".join(f"when '{k}' then '{v}'" for k, v in display.ENUM_LABELS.items())
    return f"case when {_MISS.format(c)} then '—' else case {_KEY.format(c)} {labels} else {_WORDS.format(c)} end end"


_BADGE = " ".join(f"when lower(trim(official_status)) in ({', '.join(map(repr, names))}) then '{colour}'" for colour, names in display.BADGES.items())
SQL = {
    "filter_market": f"{_ALL} select bar_id, feed, date, close from bars where symbol = 'MKTX' and date between '{START}' and '{END}'",
    "security_history": f"{_ALL} select bar_id, feed, date, close from bars where symbol = 'MKTX'",
    "period_filter": f"{_ALL} select bar_id, symbol, date, close from bars where date >= (select max(date) from bars) - interval 6 month",
    "dataset_summary": "select count(distinct date) as trading_days, count(distinct upper(trim(symbol))) as symbols, count(*) as rows, min(date) as first_date, max(date) as last_date from market_bars",
    "null_counts": " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as nulls from market_bars" for c in ("bar_id", "symbol", "feed", "date", "ldcp", "open", "high", "low", "close", "change", "change_percent", "volume", "load_id", "ingested_at")),
    "history_lengths": "with n as (select count(*) as n from market_bars group by feed, upper(trim(symbol))) select count(*) as symbols, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as deviation, min(n) as least, quantile_cont(n, 0.25)::double as p25, quantile_cont(n, 0.5)::double as p50, quantile_cont(n, 0.75)::double as p75, max(n) as greatest from n",
    "option_lists": "select distinct trim(sector) as sector from registry_updates where trim(sector) <> ''",
    "newest_first": f"{_ALL} select bar_id, symbol, date, close, row_number() over (order by date desc nulls last, symbol nulls last, bar_id) as row from bars",
    "sorted_market": f"{_ALL} select bar_id, symbol, date, close, row_number() over (order by date nulls last, symbol nulls last, bar_id) as row from bars",
    "paginate": f"{_ALL} select bar_id, symbol, date, close from bars order by date desc nulls last, symbol, bar_id limit 25 offset 50",
    "latest_row": f"with {DAYS} select feed, symbol, date, open, close, volume from force qualify row_number() over (partition by feed, symbol order by date desc) = 1",
    "tail_rows": f"with {DAYS} select feed, symbol, date, close from force qualify row_number() over (partition by feed, symbol order by date desc) <= 20",
    "union_all": f"{_ALL} select bar_id, symbol from bars where volume = 0 union all select bar_id, symbol from bars where change = 0",
    "except_dates": "select date from market_bars except select date from trading_calendar where is_open",
    "intersect_dates": f"{_ALL} select date from bars where symbol = 'MKTX' intersect select date from bars where symbol <> 'MKTX'",
    "missing_dates": f"with {_DAYS} select date from days where date not in (select date from market_bars where date is not null)",
    "state_transition": f"with {_STATES} select * from states",
    "backfill_plan": f"with {_PLAN} select date, plan from plan",
    "backfill_totals": f"with {_PLAN} select plan, count(*) as dates, case when plan = 'request' then greatest(0, count(*) - 1) * 2.0::double else 0.0::double end as minimum_seconds from plan group by 1",
    "empty_response_class": f"with {_DAYS} select date, case when isodow(date) >= 6 then 'non_trading' when date '{TODAY}' - date <= 2 then 'temporary_unavailable' else 'non_trading' end as state from days",
    "calendar_days": f"select date, isodow(date) >= 6 as is_weekend, (date '{TODAY}' - date)::int as age_days from trading_calendar",
    "security_type_inference": f"""select update_id, case when regexp_matches({_TOLD}, '\\bRIGHTS?\\b') then 'right' when contains(upper(symbol), 'ETF') or regexp_matches({_TOLD}, '\\bETF\\b') or contains({_TOLD}, 'EXCHANGE TRADED FUND') then 'etf' when contains({_TOLD}, 'PREF') then 'preference_share' when board = 'gem' then 'gem_equity'
      when contains({_TOLD}, 'REAL ESTATE INVESTMENT TRUST') or regexp_matches({_TOLD}, '\\bREIT\\b') then 'other' else 'ordinary_equity' end as inferred, case when regexp_matches(upper(trim(symbol)), '{registry.LISTED_IN_MONTH}') then 'other' else 'unknown' end as from_history from registry_updates""",
    "normalize_text": """select update_id, coalesce(trim(regexp_replace(company_name, '\\s+', ' ', 'g')), '') as company_name, upper(trim(symbol)) as symbol, regexp_replace(regexp_replace(lower(trim(sector)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as header,
      concat_ws('; ', nullif(coalesce(trim(regexp_replace(sector, '\\s+', ' ', 'g')), ''), ''), nullif(coalesce(trim(regexp_replace(board, '\\s+', ' ', 'g')), ''), '')) as note from registry_updates""",
    "symbol_labels": f"select update_id, case when not {_MISS.format('symbol')} and not {_MISS.format('company_name')} then trim(company_name) || ' (' || trim(symbol) || ')' when not {_MISS.format('company_name')} then trim(company_name) when not {_MISS.format('symbol')} then trim(symbol) else '—' end as label from registry_updates",
    "enum_humanize": f"select update_id, {_human('lifecycle_status')} as lifecycle, case {_BADGE} else 'gray' end as badge, {_human('source')} as source from registry_updates",
    "volume_abbrev": "select bar_id, case when volume is null then '—' when abs(volume) >= 1e12 then printf('%.1fT', round_even(volume / 1e12, 1)) when abs(volume) >= 1e9 then printf('%.1fB', round_even(volume / 1e9, 1)) when abs(volume) >= 1e6 then printf('%.1fM', round_even(volume / 1e6, 1)) when abs(volume) >= 1e3 then printf('%.1fK', round_even(volume / 1e3, 1)) else volume::varchar end as volume, coalesce(strftime(date, '%d %b %Y'), '—') as day, coalesce(format('{:,}', volume), '—') as whole from market_bars",
    "display_numbers": """select bar_id, case when close is null then '—' else 'PKR ' || format('{:,.2f}', round_even(close, 2)) end as price, case when change_percent is null then '—' else case when change_percent > 0 then '▲ +' when change_percent < 0 then '▼ ' else '● ' end || format('{:,.2f}', round_even(change_percent, 2) + 0.0) || '%' end as move,
      coalesce(strftime(ingested_at, '%d %b %Y, %-I:%M %p PKT'), '—') as at from market_bars""",
    "display_times": "select update_id, coalesce(strftime(try_cast(trim(registry_updated_at) as timestamptz) at time zone 'Asia/Karachi', '%d %b %Y, %-I:%M %p PKT'), '—') as at from registry_updates",
    "display_summary": f"""with {FINAL}, per as (select feed, upper(trim(symbol)) as symbol, min(date) as lo, max(date) as hi, count(distinct date) as n from market_bars where date is not null and trim(symbol) <> '' group by 1, 2), last as (select feed, upper(trim(symbol)) as symbol, close from market_bars where date is not null qualify row_number() over (partition by feed, upper(trim(symbol)) order by date desc, bar_id desc) = 1)
      select p.feed, case when {_MISS.format('p.symbol')} then '—' else p.symbol end as "Symbol", case when {_MISS.format('company_name')} then '—' else trim(company_name) end as "Company Name", {_human('security_type')} as "Security Type", case when {_MISS.format('sector')} then '—' else trim(sector) end as "Sector", {_human('official_status')} as "Official Status", {_human('activity_status')} as "Trading Activity",
      {_human('lifecycle_status')} as "Lifecycle Status", lo as "First Seen", hi as "Last Seen", n as "Trading Days", close as "Latest Close" from per p left join last using (feed, symbol) left join final f on f.symbol = p.symbol""",
    "display_models": f"""with {_MODELS} select model_id, {_human('model_scope')} as "Model scope", case when {_MISS.format('symbol')} then 'Master model' else trim(symbol) end as "Symbol", coalesce(format('{{:,}}', model_version), '—') as "Version", {_human('model_status')} as "Model status", '—' as "Last trained", '—' as "Training start",
      coalesce(strftime(training_data_end, '%d %b %Y'), '—') as "Training end", coalesce(format('{{:,}}', model_version % 7), '—') as "New trading days", case when model_id % 3 = 0 then 'Recommended' else 'Not needed' end as "Retraining recommendation" from models""",
    "model_ids": "select build_id, 'ppo-symbol-' || regexp_replace(trim(symbol), '[^A-Za-z0-9._-]+', '_', 'g') || '-v' || lpad(output_rows::varchar, greatest(4, length(output_rows::varchar))::int, '0') as model_id from dataset_builds",
    "json_observations": """select index_code, case when value is not null and volume is not null and open is not null then timestamp end as timestamp, case when value is not null and volume is not null and open is not null then (to_timestamp(timestamp) at time zone 'Asia/Karachi')::date end as date,
      case when volume is not null and open is not null then round(value, 6) end as value, case when value is not null and open is not null then volume end as volume, case when value is not null and volume is not null then round(open, 6) end as open,
      case when value is null or volume is null or open is null or timestamp is null then 'expected 4 numbers' when volume < 0 then 'volume is negative' else '' end as reason from index_observations""",
    "html_cells": """select date::varchar || '/' || load_id || '/' || feed as page_id, date, upper(trim(symbol)) as symbol, round(ldcp, 6) as ldcp, round(close, 6) as close, volume, case when ldcp is null then 'ldcp is empty' when open is null then 'open is empty' when high is null then 'high is empty' when low is null then 'low is empty' when close is null then 'close is empty'
      when change is null then 'change is empty' when change_percent is null then 'change_percent is empty' when volume is null then 'volume is empty' else '' end as reason from market_bars""",
}
