"""Queries against their SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from tapemill.plans import registry

NAMES = (
    "p1_found", "p1_figures", "p2_found", "p2_wide", "p3_found", "p3_known", "p4_found", "p4_history", "p5_found", "p5_grid", "p6_found", "p7_found", "p7_profile", "features_full", "warmup_counts", "master_dedup", "conflict_report", "status_priority_dedup", "record_validation", "quality_errors", "registry_outer_merge",
    "override_merge", "company_summary", "index_metrics", "index_context_wide", "market_breadth", "market_health", "context_asof_join", "dataset_with_context", "standard_scale", "readiness_report", "status_table", "newest_first", "null_counts", "backfill_plan", "enum_humanize", "display_numbers", "display_times", "display_summary", "display_models", "json_observations", "html_cells",
)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v.date() if isinstance(v, datetime) and v.time() == datetime.min.time() else v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    told = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in told.fetchall())


def test_no_query_leaves_out_a_feed_or_the_heaviest_symbol(spark, sf):
    q = registry.queries()
    bars = spark.read.parquet(f"{sf}/market_bars.parquet")
    feeds = {r[0] for r in bars.select("feed").distinct().collect()}
    for name in ("master_dedup", "company_summary", "market_breadth_by_date", "context_asof_join", "quality_errors"):
        assert {r[0] for r in q[name](spark, sf).select("feed").distinct().collect()} == feeds, name
    for name in ("daily_bars", "features_full"):
        assert {r[0].split("/")[0] for r in q[name](spark, sf).select("symbol").distinct().collect()} == feeds, name
    assert q["registry_outer_merge"](spark, sf).where("symbol = 'MKTX' and trading_days > 0").count() == 1
    assert q["html_cells"](spark, sf).count() == q["newest_first"](spark, sf).count() == bars.count()


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
