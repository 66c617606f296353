"""The general problems' queries in SQL, written from the statements and independent of the operators."""

_FORCE = """
force as (
  select upper(trim(symbol)) as symbol, feed, date, max(ingested_at) as at
  from market_bars group by 1, 2, 3),
bars as (
  select upper(trim(b.symbol)) as symbol, b.feed, b.date, max(b.close) as close, max(b.volume) as volume, max(b.change_percent) as change_percent
  from market_bars b join force f on upper(trim(b.symbol)) = f.symbol and b.feed = f.feed and b.date = f.date and b.ingested_at = f.at
  group by 1, 2, 3)"""

P1 = f"""
with {_FORCE},
moves as (
  select symbol, feed, date, close / lag(close) over (partition by symbol, feed order by date) - 1 as r from bars where close > 0),
figures as (
  select i.symbol, i.feed, i.date,
    (select coalesce(sum(b.volume), 0) from bars b where b.symbol = i.symbol and b.feed = i.feed and b.date between i.date - 6 and i.date) as t7,
    (select coalesce(sum(b.volume), 0) from bars b where b.symbol = i.symbol and b.feed = i.feed and b.date between i.date - 29 and i.date) as t30,
    (select coalesce(sum(b.volume), 0) / 20.0 from bars b where b.symbol = i.symbol and b.feed = i.feed and b.date between i.date - 19 and i.date) as v20,
    (select avg(b.close) from bars b where b.symbol = i.symbol and b.feed = i.feed and b.date between i.date - 19 and i.date) as s20,
    (select stddev_samp(m.r) from moves m where m.symbol = i.symbol and m.feed = i.feed and m.date between i.date - 19 and i.date) as d20
  from indicators i)
select i.symbol, i.feed, strftime(i.date, '%Y-%m-%d') as bar_day
from indicators i join figures f on i.symbol = f.symbol and i.feed = f.feed and i.date = f.date
where i.volume_total_7 is distinct from f.t7 or i.volume_total_30 is distinct from f.t30
  or (i.volume_ma_20 is null) <> (f.v20 is null) or (abs(i.volume_ma_20 - f.v20) > 0.001 * abs(f.v20) and abs(i.volume_ma_20 - f.v20) > 1e-6)
  or (i.sma_20 is null) <> (f.s20 is null) or (abs(i.sma_20 - f.s20) > 0.001 * abs(f.s20) and abs(i.sma_20 - f.s20) > 1e-6)
  or (i.rolling_volatility_20 is null) <> (f.d20 is null) or (abs(i.rolling_volatility_20 - f.d20) > 0.001 * f.d20 and abs(i.rolling_volatility_20 - f.d20) > 1e-6)
"""


def _spike(field: str) -> str:
    return f"""
select symbol, feed, date, '{field}' as field from (
  select *, median(abs(up)) filter (where up <> 0) over (partition by symbol, feed) as size from (
    select symbol, feed, date, ln({field} / lag({field}) over w) as up, ln({field} / lead({field}) over w) as down
    from bars where {field} > 0 window w as (partition by symbol, feed order by date)))
where (up > 10 * size and down > 10 * size) or (up < -10 * size and down < -10 * size)"""


def _stuck(field: str) -> str:
    return f"""
select symbol, feed, date, '{field}' as field from (
  select *, count(*) over (partition by symbol, feed, run) as many from (
    select *, sum(case when flat then 0 else 1 end) over (partition by symbol, feed order by date) as run from (
      select *, coalesce({field} = lag({field}) over w and {field} <> 0 and coalesce(volume, 1) <> 0 and coalesce(lag(volume) over w, 1) <> 0, false) as flat
      from bars where {field} is not null window w as (partition by symbol, feed order by date))))
where many >= 5 and flat"""


P2 = f"""
with {_FORCE},
cases as (
  select symbol, feed, date, 'close' as field from bars where close <= 0
  union select symbol, feed, date, 'volume' from bars where volume < 0
  union select symbol, feed, date, 'change_percent' from bars where change_percent < -100
  union {_spike('close')}
  union {_spike('volume')}
  union select symbol, feed, date, 'change_percent' from (
    select *, median(abs(change_percent)) filter (where change_percent <> 0) over (partition by symbol, feed) as size from bars) where abs(change_percent) > 10 * size
  union {_stuck('close')}
  union {_stuck('volume')}
  union {_stuck('change_percent')})
select b.bar_id, c.field from market_bars b join cases c on upper(trim(b.symbol)) = c.symbol and b.feed = c.feed and b.date = c.date
"""

_SAME = "nullif(replace(replace(lower(trim({0})), ' ', '_'), '-', '_'), '')"
_BUILDS = f"""
with told as (
  select upper(trim(symbol)) as symbol, {_SAME.format('security_type')} as kind, officially_listed as listed, received_at, update_id, registry_updated_at::timestamptz at time zone 'UTC' as valid_at from registry_updates),
known as (
  select b.build_id,
    arg_max(t.kind, (t.valid_at, t.received_at, t.update_id)) filter (where t.kind is not null) as known_security_type,
    arg_max(t.listed, (t.valid_at, t.received_at, t.update_id)) filter (where t.listed is not null) as known_officially_listed
  from dataset_builds b left join told t on upper(trim(b.symbol)) = t.symbol and t.valid_at <= b.built_at and t.received_at <= b.built_at
  group by 1),
context as (
  select b.build_id, arg_max(o.value, (o.date, o.fetched_at, o.timestamp)) as known_context
  from dataset_builds b join index_observations o on upper(trim(b.context_index_code)) = upper(trim(o.index_code)) and o.fetched_at <= b.built_at
  where b.market_context_included group by 1)
"""
P3_KNOWN = _BUILDS + "select build_id, known_security_type, known_officially_listed, known_context from known left join context using (build_id)"
P3 = _BUILDS + f"""
select b.build_id from dataset_builds b join known using (build_id) left join context using (build_id)
where {_SAME.format('b.security_type')} is distinct from known_security_type or b.officially_listed is distinct from known_officially_listed
  or (b.market_context_included and b.context_value is distinct from known_context)
"""

_VERSIONS = f"""
with told as (
  select upper(trim(symbol)) as symbol, registry_updated_at::timestamptz at time zone 'UTC' as t, received_at, update_id, {_SAME.format('official_status')} as o, {_SAME.format('lifecycle_status')} as l from registry_updates),
single as (select * from told qualify row_number() over (partition by symbol, t order by received_at desc, update_id desc) = 1),
filled as (
  select symbol, t, last_value(o ignore nulls) over w as o, last_value(l ignore nulls) over w as l from single
  window w as (partition by symbol order by t rows between unbounded preceding and current row)),
versions as (
  select * from (select *, row_number() over w as n, lag(o) over w as po, lag(l) over w as pl from filled window w as (partition by symbol order by t))
  where n = 1 or o is distinct from po or l is distinct from pl)
"""
P4_HISTORY = _VERSIONS + "select symbol, epoch(t)::bigint as valid_from_epoch, epoch(lead(t) over (partition by symbol order by t))::bigint as valid_to_epoch, o as official_status, l as lifecycle_status from versions"
P4 = _VERSIONS + "select symbol, epoch(t)::bigint as valid_from_epoch from versions"

P5 = """
with lives as (select upper(trim(symbol)) as symbol, feed, min(date) as a, max(date) as z from market_bars group by 1, 2),
seen as (select distinct upper(trim(symbol)) as symbol, feed, date from market_bars where close is not null)
select l.symbol, l.feed, strftime(c.date, '%Y-%m-%d') as bar_day
from lives l join trading_calendar c on c.is_open and c.date between l.a and l.z
where not exists (select 1 from seen s where s.symbol = l.symbol and s.feed = l.feed and s.date = c.date)
"""

P5_GRID = """
with lives as (select upper(trim(symbol)) as symbol, feed, min(date) as a, max(date) as z from market_bars group by 1, 2),
seen as (select upper(trim(symbol)) as symbol, feed, date, arg_max(close, ingested_at) as close from market_bars where close is not null group by 1, 2, 3),
grid as (select l.symbol, l.feed, c.date from lives l join trading_calendar c on c.is_open and c.date between l.a and l.z),
near as (
  select g.symbol, g.feed, g.date, (s.date - g.date)::double as k, s.close as y, pow(1 - pow(abs(s.date - g.date) / 10.0::double, 3), 3) as w
  from grid g join seen s on s.symbol = g.symbol and s.feed = g.feed and s.date between g.date - 9 and g.date + 9 where s.close > 0),
sums as (select symbol, feed, date, sum(w) as s0, sum(w * k) as s1, sum(w * k * k) as s2, sum(w * y) as t0, sum(w * k * y) as t1, sum(w * w) as w2 from near group by 1, 2, 3),
fits as (select symbol, feed, date, case when s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 then (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) else t0 / s0 end as fit, s0 * s0 / w2 as support from sums)
select symbol, feed, date, case when s.close is not null then 'observed' when coalesce(support, 0) >= 2 then 'filled' else 'missing' end as status,
  round(case when s.close is not null then s.close when coalesce(support, 0) >= 2 then fit end, 4) as close, round(coalesce(support, 0), 4) as support
from grid g left join fits using (symbol, feed, date) left join seen s using (symbol, feed, date)
"""

_RULES = {
    "high": ["high is null", "coalesce(high < greatest(open, close), false)", "coalesce(abs(high / nullif(close, 0)) > 1.5 or abs(high / nullif(close, 0)) < 1 / 1.5, false)", "coalesce(high = floor(high), false)"],
    "low": ["low is null", "coalesce(low > least(open, close), false)", "coalesce(abs(low / nullif(close, 0)) > 1.5 or abs(low / nullif(close, 0)) < 1 / 1.5, false)", "coalesce(low = floor(low), false)"],
}
_RATES = " union all ".join(
    f"select load_id, '{c}' as column_name, {', '.join(f'avg(({r})::int) as r{i}' for i, r in enumerate([*rules, ' or '.join(rules)]))} from market_bars group by load_id" for c, rules in _RULES.items()
)
P7 = f"""
with rates as ({_RATES}), told as (select r.*, l.loader from rates r join market_loads l using (load_id)),
above as (select load_id, column_name, greatest({', '.join(f'r{i} - median(r{i}) over (partition by loader, column_name)' for i in range(5))}) as excess from told)
select load_id, column_name from above where excess >= 0.1 - 1e-12
union all
select l.load_id, 'duplicate_count' from market_loads l left join (
  select load_id, count(*) - count(distinct (upper(trim(symbol)), feed, date)) as n from market_bars group by 1) d using (load_id)
where l.duplicate_count is distinct from coalesce(d.n, 0)
"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NUM = "^[+-]?[0-9]+(\\.[0-9]+)?$"
P6 = f"""
with lines as (select line_id, regexp_replace(coalesce(raw_text, ''), '\\r?\\n?$', '') as t from raw_lines),
sound as (select line_id, t, regexp_matches(t, '^{_FIELD}(,{_FIELD})*$') as ok, regexp_replace(t, '"([^"]|"")*"', 'q', 'g') as flat from lines),
counted as (select *, length(flat) - length(replace(flat, ',', '')) + 1 as n from sound),
fields as (
  select line_id, ok, n, case when ok and n = 10 then list_transform(regexp_extract_all(',' || t, ',({_FIELD})', 1),
    lambda x: trim(case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end)) end as f from counted),
numbers as (select *, list_transform(f, lambda x: replace(x, ',', '')) as g from fields)
select line_id, case when not ok then 'broken_quoting' when n <> 10 then 'column_count' else 'invalid_value' end as reason from numbers
where not (ok and n = 10 and coalesce(f[1] <> '' and regexp_matches(f[2], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(f[2] as date) is not null
  and regexp_matches(g[3], '{_NUM}') and regexp_matches(g[4], '{_NUM}') and regexp_matches(g[5], '{_NUM}') and regexp_matches(g[6], '{_NUM}')
  and regexp_matches(g[7], '{_NUM}') and regexp_matches(g[8], '{_NUM}') and regexp_matches(regexp_replace(g[9], '%$', ''), '{_NUM}')
  and regexp_matches(g[10], '^[0-9]+$') and try_cast(g[5] as double) >= try_cast(g[6] as double), false))
"""

P1_FIGURES = f"""
with {_FORCE},
moves as (select symbol, feed, date, close / lag(close) over (partition by symbol, feed order by date) - 1 as r from bars where close > 0),
lives as (select symbol, feed, min(date) as a, max(date) as z from bars group by 1, 2),
days as (select symbol, feed, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as date from lives),
dense as (
  select d.symbol, d.feed, d.date, b.close, b.volume, m.r from days d left join bars b on b.symbol = d.symbol and b.feed = d.feed and b.date = d.date left join moves m on m.symbol = d.symbol and m.feed = d.feed and m.date = d.date)
select symbol, feed, date, coalesce(sum(volume) over (w rows 6 preceding), 0)::bigint as volume_total_7, coalesce(sum(volume) over (w rows 29 preceding), 0)::bigint as volume_total_30, round(coalesce(sum(volume) over (w rows 19 preceding), 0) / 20.0::double, 6) as volume_ma_20,
  round(avg(close) over (w rows 19 preceding), 6) as sma_20, round(stddev_samp(r) over (w rows 19 preceding), 6) as rolling_volatility_20
from dense window w as (partition by symbol, feed order by date)
"""

_REASONS = f"""
with {_FORCE},
reasons as (
  select symbol, feed, date, 'close' as field, 1 as k from bars where close <= 0
  union all select symbol, feed, date, 'volume', 1 from bars where volume < 0
  union all select symbol, feed, date, 'change_percent', 1 from bars where change_percent < -100
  union all select *, 2 from ({_spike('close')}) union all select *, 2 from ({_spike('volume')})
  union all select symbol, feed, date, 'change_percent', 2 from (
    select *, median(abs(change_percent)) filter (where change_percent <> 0) over (partition by symbol, feed) as size from bars) where abs(change_percent) > 10 * size
  union all select *, 3 from ({_stuck('close')}) union all select *, 3 from ({_stuck('volume')}) union all select *, 3 from ({_stuck('change_percent')}))
select symbol, feed, date, field, ['impossible', 'spike', 'stuck'][min(k)] as reason from reasons group by symbol, feed, date, field
"""



def _edges(field: str) -> str:
    """The widest-first scan of spikes of one, two and four positive readings, by means of logarithms beside each other."""
    h = (1, 2, 4)
    mean = lambda frame, n: f"case when count(*) over ({frame}) = {n} then avg(ln({field})) over ({frame}) end"
    by = "partition by symbol, feed order by date rows between"
    diff = lambda n: f"{mean(f'{by} current row and {n - 1} following', n)} - {mean(f'{by} {n} preceding and 1 preceding', n)}"
    level = lambda sign: [" and ".join(f"d{k} {'>' if sign > 0 else '<'} {sign * 10} * m{k}" for k in h if k <= n) for n in h]
    ups, downs = level(1), level(-1)
    edges = ", ".join(f"coalesce({u}, false) as u{n}, coalesce({v}, false) as v{n}" for n, u, v in zip(h, ups, downs, strict=True))
    starts = ", ".join(f"(u{n} and coalesce(lead(v{n}, {n}) over w, false)) or (v{n} and coalesce(lead(u{n}, {n}) over w, false)) as s{n}" for n in h)
    inside = " ".join(f"when {' or '.join(f'coalesce(lag(s{n}, {i}) over w, false)' for i in range(n))} then {n}" for n in h)
    return f"""
select symbol, feed, date, '{field}' as field, case {inside} end as width from (
  select *, {starts} from (
    select *, {edges} from (
      select *, {', '.join(f'median(abs(d{n})) filter (where abs(d{n}) > 1e-9) over (partition by symbol, feed) as m{n}' for n in h)} from (
        select symbol, feed, date, {', '.join(f'{diff(n)} as d{n}' for n in h)} from bars where {field} > 0)) window w as (partition by symbol, feed order by date)) window w as (partition by symbol, feed order by date))
window w as (partition by symbol, feed order by date)"""


P2_WIDE = f"with {_FORCE} select symbol, feed, date, field, width from ({_edges('close')} union all {_edges('volume')}) where width > 1"

_LOADED = P6[: P6.rindex("select line_id, case when not ok")]
_CONFORMS = P6[P6.rindex("where not (ok and n = 10") + len("where not (") : P6.rindex(")")]
P6_ROWS = f"""{_LOADED} select line_id, source_file, line_no, f[1] as symbol, f[2]::date as date, g[3]::double as ldcp, g[4]::double as open, g[5]::double as high, g[6]::double as low, g[7]::double as close, g[8]::double as change,
  regexp_replace(g[9], '%$', '')::double as change_percent, g[10]::bigint as volume from numbers join raw_lines using (line_id) where {_CONFORMS}"""
P6_FILES = f"""{_LOADED}, counts as (select source_file, count(*) as parsed_rows, count(*) filter (where not ({_CONFORMS})) as rejected_rows from numbers join raw_lines using (line_id) group by 1)
select source_file, coalesce(c.parsed_rows, 0) as parsed_rows, coalesce(c.parsed_rows - c.rejected_rows, 0) as valid_rows, coalesce(c.rejected_rows, 0) as rejected_rows, r.valid_rows as stated_valid, r.rejected_rows as stated_rejected,
  coalesce(coalesce(c.rejected_rows, 0) = r.rejected_rows, false) and coalesce(coalesce(c.parsed_rows - c.rejected_rows, 0) = r.valid_rows, false) as agrees from counts c full join fetch_results r using (source_file)"""


def _profile(column: str, number: str | None) -> str:
    x = f"{column}::{number}" if number else "null::double"
    text = {"symbol": "count(*) filter (where not regexp_matches(symbol, '^[A-Z0-9]+(-[A-Z]{3})?$'))", "feed": "count(*) filter (where not regexp_matches(feed, '^[a-z0-9_]+$'))"}.get(column, "0::bigint")
    return f"select load_id, '{column}' as column_name, count(*) as rows, count(*) - count({column}) as nulls, count(distinct {column}) as distinct_values, {text} as pattern_violations, count({x}) as n, sum({x})::double as s1, sum(({x})::double * ({x})::double) as s2 from market_bars group by 1"


_KINDS = dict.fromkeys(("ldcp", "open", "high", "low", "close", "change", "change_percent"), "decimal(18,4)") | {"volume": "decimal(18,0)"}
P7_PROFILE = f"""
with sums as ({" union all ".join(_profile(c, _KINDS.get(c)) for c in ("bar_id", "symbol", "feed", "date", *_KINDS, "ingested_at"))})
select load_id, column_name, rows, nulls, distinct_values, pattern_violations, round(s1 / nullif(n, 0), 4) as mean, case when n > 1 then round(sqrt(greatest(0, (s2 - s1 * s1 / n) / (n - 1))), 2) end as deviation from sums
"""



def _whole_profile(column: str) -> str:
    number = _KINDS.get(column)
    shown = (lambda x: f"{x}::{number}::varchar") if number else (lambda x: f"{x}::varchar")
    x = f"{column}::{number}" if number else "null::double"
    pattern = {"symbol": "count(*) filter (where not regexp_matches(symbol, '^[A-Z0-9]+(-[A-Z]{3})?$'))", "feed": "count(*) filter (where not regexp_matches(feed, '^[a-z0-9_]+$'))"}.get(column, "0::bigint")
    broken = f"count(*) filter (where {' or '.join(_RULES[column])})" if column in _RULES else "0::bigint"
    return f"""select load_id, '{column}' as column_name, count(*) as rows, count(*) - count({column}) as nulls, count(distinct {column}) as distinct_values, {shown(f'min({column})')} as least, {shown(f'max({column})')} as greatest, {pattern} as pattern_violations, {broken} as rule_violations,
      count({x}) as n, sum({x})::double as s1, sum(({x})::double * ({x})::double) as s2 from market_bars group by 1"""


P7_WHOLE = f"""
with sums as ({" union all ".join(_whole_profile(c) for c in ("bar_id", "symbol", "feed", "date", *_KINDS, "ingested_at"))}),
told as (select s.*, loader, sum(n) over w - n as others_n, sum(s1) over w - coalesce(s1, 0) as o1, sum(s2) over w - coalesce(s2, 0) as o2 from sums s left join market_loads using (load_id) window w as (partition by loader, column_name)),
spread as (select *, s1 / nullif(n, 0) as mean, o1 / nullif(others_n, 0) as others, greatest(0, s2 - s1 * s1 / nullif(n, 0)) as q, greatest(0, o2 - o1 * o1 / nullif(others_n, 0)) as oq from told),
usual as (select *, median(mean) over w as um, median(q / nullif(n, 0)) over w as uv from spread window w as (partition by loader, column_name))
select load_id, column_name, rows, nulls, round(nulls / rows, 6) as null_rate, distinct_values, least, greatest, pattern_violations, rule_violations, 0::bigint as unsummed, round(mean, 4) as mean, case when n > 1 then round(sqrt(q / (n - 1)), 2) end as deviation,
  round((mean - others) / nullif(case when n > 1 and others_n > 1 then sqrt((q / (n - 1) + oq / (others_n - 1)) / 2) end, 0), 4) as standardised_difference, round((mean - um) / sqrt((q / nullif(n, 0) + uv) / 2), 4) as usual_difference
from usual
"""

SQL = {
    "p1_found": P1, "p1_figures": P1_FIGURES, "p2_found": P2, "p2_reasons": _REASONS, "p2_wide": P2_WIDE, "p3_found": P3, "p3_known": P3_KNOWN, "p4_found": P4, "p4_history": P4_HISTORY, "p5_found": P5, "p5_grid": P5_GRID,
    "p6_found": P6, "p6_rows": P6_ROWS, "p6_files": P6_FILES, "p7_found": P7, "p7_profile": P7_WHOLE, "p7_rates": P7_PROFILE,
}
