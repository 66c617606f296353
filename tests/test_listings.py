"""The registry over all listings: unmatched on either side, and symbols of any length."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from tapemill.plans import registry

BARS = "bar_id bigint, symbol string, feed string, date date, ldcp double, open double, high double, low double, close double, change double, change_percent double, volume bigint, load_id bigint, ingested_at timestamp_ntz"
UPDATES = "update_id bigint, symbol string, company_name string, security_type string, sector string, board string, listing_segment string, officially_listed boolean, official_status string, source string, shares bigint, received_at timestamp_ntz"
T = datetime(2026, 7, 30)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("registry"))
    bars = [(i, s, f, date(2026, 7, 30 - i % 2), 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 5, 1, T) for i, (s, f) in enumerate([(" sixsix", "official"), ("SIXSIX", "desk"), ("HOT", "desk"), ("HOT", "desk"), ("TRADED", "desk"), ("AB", "official")])]
    spark.createDataFrame(bars, BARS).write.parquet(f"{d}/market_bars.parquet")
    updates = [(i, s, s.lower(), "ordinary_equity", "x", "main", "m", True, "listed", "page", shares, T) for i, (s, shares) in enumerate([("SIXSIX", 5), ("HOT", 7), ("AB", 4), ("LISTED", 3), ("LI", None)])]
    spark.createDataFrame(updates, UPDATES).write.parquet(f"{d}/registry_updates.parquet")
    return d


def test_every_listing_is_merged(spark, tables):
    q = registry.queries()
    got = {r["symbol"]: r for r in q["registry_outer_merge"](spark, tables).collect()}
    assert set(got) == {"SIXSIX", "HOT", "AB", "LISTED", "LI", "TRADED"}
    assert {s for s, r in got.items() if r["officially_listed"]} == {"SIXSIX", "HOT", "AB", "LISTED", "LI"}
    assert {s for s, r in got.items() if not r["trading_days"]} == {"LISTED", "LI"}
    assert got["TRADED"]["official_status"] == "historical" and got["SIXSIX"]["trading_days"] == 2
    counts = q["registry_counts"](spark, tables).first()
    assert (counts["total"], counts["listed"], counts["listed_idle"], counts["ordinary_equity"]) == (6, 5, 2, 5)
    assert {r["symbol"] for r in q["company_summary"](spark, tables).where("company_name = 'sixsix'").collect()} == {"SIXSIX"}
    restricted = {(r["feed"], r["symbol"]): r["rows"] for r in q["semi_restrict"](spark, tables).collect()}
    assert restricted == {("official", "SIXSIX"): 1, ("desk", "SIXSIX"): 1, ("desk", "HOT"): 2, ("official", "AB"): 1}


def test_every_listing_is_overridden(spark, tables):
    q = registry.queries()
    got = {r["symbol"]: r for r in q["override_merge"](spark, tables).collect()}
    assert {s for s, r in got.items() if r["successor_symbol"] == "NEXT"} == {"SIXSIX", "HOT", "AB", "LISTED", "LI"}
    assert {s for s, r in got.items() if r["official_status"] == "suspended"} == {"AB"}
    assert {r["symbol"] for r in q["unknown_overrides_anti"](spark, tables).collect()} == {"LISTED", "LI"}
