"""Rejects (P6) and profiles."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tapemill.operators import profile, rejects

GOOD = 'AB,2025-01-02,"1,000.5",+2,3,1,2,-0.5,1.2%,"1,000"'
LINES = {
    GOOD: "",
    GOOD + "\r": "",
    GOOD.replace("AB", '"A""B,C"'): "",
    " AB , 2025-01-02 ,1,2,3,3,2,1,1 ,7 ": "",
    "": "column_count",
    "\r": "column_count",
    None: "column_count",
    "a,b": "column_count",
    GOOD + ",1": "column_count",
    GOOD.replace("AB", 'A"B'): "broken_quoting",
    GOOD.replace("AB", '"AB"x'): "broken_quoting",
    GOOD.replace("AB", '"A"B"'): "broken_quoting",
    GOOD.replace("AB", '"AB'): "broken_quoting",
    ' "AB"' + GOOD[2:]: "broken_quoting",
    GOOD.replace("AB", '""'): "invalid_value",
    GOOD.replace("01-02", "02-30"): "invalid_value",
    GOOD.replace("2025-01-02", "2025-1-2"): "invalid_value",
    GOOD.replace("+2", "1e3"): "invalid_value",
    GOOD.replace("+2", ""): "invalid_value",
    GOOD.replace("+2", "2%"): "invalid_value",
    GOOD.replace("1.2%", "1.2%%"): "invalid_value",
    GOOD.replace('"1,000"', "-5"): "invalid_value",
    GOOD.replace('"1,000"', "5.0"): "invalid_value",
    GOOD.replace(",3,1,2", ",3,4,2"): "invalid_value",
    "x" * 200_000: "column_count",
    '"' + '""' * 100_000 + '"': "column_count",
    "," * 100_000: "column_count",
    '"' * 100_001: "broken_quoting",
}


def lines(spark, texts):
    rows = [(i, "f", i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "line_id bigint, source_file string, line_no int, raw_text string, line string, symbol int")


def test_reasons(spark):
    df = lines(spark, LINES)
    got = {r["line_id"]: r["reason"] for r in rejects.rejected(df).collect()}
    assert got == {i: reason for i, reason in enumerate(LINES.values()) if reason}
    loaded = {r["line_id"]: r for r in rejects.load_strict(df).collect()}
    assert sorted(loaded) == [0, 1, 2, 3]
    assert loaded[0]["ldcp"] == 1000.5 and loaded[0]["volume"] == 1000 and loaded[0]["change_percent"] == 1.2 and loaded[0]["date"] == date(2025, 1, 2)
    assert loaded[2]["symbol"] == 'A"B,C' and loaded[3]["symbol"] == "AB"


def test_files(spark):
    df = lines(spark, LINES)
    stated = spark.createDataFrame([("f", 4, 24), ("g", 0, None)], "source_file string, valid_rows int, rejected_rows int")
    got = {r["source_file"]: r for r in rejects.rejects_by_file(df, stated).collect()}
    assert (got["f"]["valid_rows"], got["f"]["rejected_rows"], got["f"]["agrees"]) == (4, 24, True)
    assert (got["g"]["parsed_rows"], got["g"]["rejected_rows"], got["g"]["agrees"]) == (0, 0, False)
    assert rejects.rejected(df.limit(0)).count() == 0


BARS = "bar_id bigint, symbol string, feed string, date date, ldcp double, open double, high double, low double, close double, change double, change_percent double, volume bigint, load_id bigint, ingested_at timestamp_ntz, rows int"
T = datetime(2025, 1, 1)


def bars(spark):
    rows = []
    for load in range(5):
        for i in range(40):
            high, low = 11.05, 9.05
            if load == 3 and i < 8:
                high = None if i < 3 else 9.0 if i < 6 else 12.0
            rows.append((load * 100 + i, "ab" if i % 2 else " AB", "x", date(2025, 1, 1 + i % 20), 10.0, 10.1, high, low, 10.2, 0.1, 1.0, 100 + i, load, T, 0))
    return spark.createDataFrame([*rows, *rows[:1]], BARS)


def test_findings(spark):
    loads = spark.createDataFrame([(i, "l", 20) for i in range(5)] + [(9, "l", 0), (8, "m", None)], "load_id bigint, loader string, duplicate_count bigint")
    got = {tuple(r) for r in profile.load_findings(bars(spark), loads).collect()}
    # 40 rows are 20 distinct days, twice; load 0 has a repeated row more.
    assert got == {(3, "high"), (0, "duplicate_count"), (8, "duplicate_count")}


def test_an_odd_load_does_not_hide_another(spark):
    rows = []
    for load, odd in ((0, 0), (1, 40), (2, 7), (3, 0), (4, 3)):
        rows += [(load * 100 + i, "AB", "x", date(2025, 1, 1) if i < 1 else None, 10.0, 10.1, None if i < odd else 11.05, 9.05, 10.2, 0.1, 1.0, 100, load, T, 0) for i in range(40)]
    loads = spark.createDataFrame([(i, "l", 38) for i in range(5)], "load_id bigint, loader string, duplicate_count bigint")
    shifted = {(r["load_id"], r["column_name"]): round(r["excess"], 3) for r in profile.shifted_prices(spark.createDataFrame(rows, BARS), loads).collect()}
    assert shifted == {(1, "high"): 0.925, (2, "high"): 0.1}
    told = {r["load_id"]: r for r in profile.compared(profile.load_sums(spark.createDataFrame(rows, BARS), ()), loads).where("column_name = 'high' and variable = 'missing'").collect()}
    assert told[1]["usual_difference"] > told[2]["usual_difference"] >= 0.2 > told[4]["usual_difference"] == 0.0 > told[0]["usual_difference"]


def test_profile(spark):
    loads = spark.createDataFrame([(i, "l", 20) for i in range(5)], "load_id bigint, loader string, duplicate_count bigint")
    got = {(r["load_id"], r["column_name"]): r for r in profile.column_profile(bars(spark), loads).collect()}
    assert len(got) == 5 * len(profile.COLUMNS)
    high = got[3, "high"]
    assert (high["nulls"], high["distinct_values"], high["rows"]) == (3, 3, 40) and abs(high["mean"] - (3 * 9 + 2 * 12 + 32 * 11.05) / 37) < 1e-12
    assert got[0, "bar_id"]["distinct_values"] == 40 and got[0, "bar_id"]["rows"] == 41
    assert got[1, "symbol"]["pattern_violations"] == 40 and got[1, "volume"]["standardised_difference"] is not None
    assert abs(got[1, "volume"]["standardised_difference"]) < 0.05
    huge = bars(spark).withColumn("close", F.when(F.col("bar_id") == 1, 1e300).otherwise(F.col("close")))
    again = {(r["load_id"], r["column_name"]): r for r in profile.column_profile(huge, loads).collect()}
    assert again[0, "close"]["unsummed"] == 1
    assert profile.column_profile(bars(spark).limit(0), loads).count() == 0
    assert profile.load_findings(bars(spark).limit(0), loads.limit(0)).count() == 0
