"""Scans, sinks and streams."""

from __future__ import annotations

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapemill.sources import files
from tapemill.streaming import ingest

HEADER = ",".join(files.DAILY)


def daily(folder, name, lines, header=HEADER, age=0):
    path = folder / name
    path.write_text("\n".join([header, *lines]) + "\n")
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


def row(symbol, day, close):
    return f"{symbol},{day},{close - 1},{close},{close + 1},{close - 1},{close},1.0,1.0,100"


def test_daily_folder(spark, tmp_path):
    daily(tmp_path, "market_2026-07-01.csv", [row("UBL", "2026-07-01", 10), row("NA", "2026-07-01", 5), row("007", "2026-07-01", 5)], age=5)
    daily(tmp_path, "market_2026-07-02.csv", [row("PPL", "2026-07-02", 10), row("UBL", "2026-07-01", 12)])
    daily(tmp_path, "market_2026-07-03.csv", [row("PPL", "no date", 10)])
    daily(tmp_path, "market_2026-07-04.csv", [])
    daily(tmp_path, "market_2026-07-05.csv", ["a,b"], header="symbol,date")
    rows, rejects = files.read_daily_folder(spark, tmp_path)
    assert [(os.path.basename(r.path), r.reason.split(":")[0]) for r in rejects] == [("market_2026-07-04.csv", "empty"), ("market_2026-07-05.csv", "missing columns"), ("market_2026-07-03.csv", "invalid dates")]
    master = {(r["symbol"], r["date"].day): r["close"] for r in files.master_dataset(rows).collect()}
    assert master == {("UBL", 1): 12.0, ("NA", 1): 5.0, ("007", 1): 5.0, ("PPL", 2): 10.0}
    assert files.available_dates(tmp_path) == [date(2026, 7, 1)]
    got, source, why = files.read_with_fallback(spark, str(tmp_path / "none"), str(tmp_path))
    assert source == "raw" and got.count() == 5 and "3 file(s)" in why
    assert files.read_daily_folder(spark, tmp_path / "nothing")[0].count() == 0


def test_the_later_row_of_a_file_wins(spark, tmp_path):
    daily(tmp_path, "market_2026-07-01.csv", [row("UBL", "2026-07-01", 10), row("PPL", "2026-07-01", 7), row("UBL", "2026-07-01", 9), row("UBL", "2026-07-01", 8)])
    rows, rejects = files.read_daily_folder(spark, tmp_path)
    assert not rejects and {r["symbol"]: r["close"] for r in files.master_dataset(rows).collect()} == {"UBL": 8.0, "PPL": 7.0}
    # As of one large file in many parts.
    big = [row(f"S{i % 50}", "2026-07-02", 1000 - i // 50) for i in range(5000)]
    daily(tmp_path, "market_2026-07-02.csv", big, age=-9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_daily_folder(spark, tmp_path)[0]
        assert rows.select("source_block").distinct().count() > 5
        got = files.master_dataset(rows).where("symbol like 'S%'")
        assert {r["close"] for r in got.collect()} == {901.0} and got.count() == 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_combined_files(spark, tmp_path):
    daily(tmp_path, "market_2026-07-01.csv", [row("UBL", "2026-07-01", 10), row("UBL", "no date", 11)])
    daily(tmp_path, "market_2026-07-02.csv", ["NA,2026-07-02,x"], header="symbol,date,note")
    daily(tmp_path, "market_2026-07-03.csv", [], header="")
    rows, rejects = files.combined(spark, [*files.listed(spark, tmp_path, "market_*.csv"), tmp_path / "none.csv"])
    assert [r.reason.split(":")[0] for r in rejects] == ["empty", "unreadable"]
    assert sorted((r["symbol"], str(r["date"]), r["close"], r["note"]) for r in rows.collect()) == [("NA", "2026-07-02", None, "x"), ("UBL", "2026-07-01", 10.0, None), ("UBL", "None", 11.0, None)]
    assert files.combined(spark, [tmp_path / "none.csv"])[0] is None


def registry_file(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *[",".join(r.get(c, "") for c in columns) for r in rows]]) + "\n")
    return path


def test_registries(spark, tmp_path):
    flags = {"officially_listed": "TRUE", "is_new_listing": "0", "cached_listings_used": "false"}
    rows, errors = files.read_company_registry(spark, registry_file(tmp_path / "r.csv", files.REGISTRY, [{"symbol": " 007 ", "first_seen_date": "2026-01-02", "last_seen_date": "soon", "trading_days": "5", **flags}]))
    one = rows.first()
    assert not errors and (one["symbol"], one["first_seen_date"], one["last_seen_date"], one["trading_days"], one["officially_listed"], one["is_new_listing"]) == ("007", date(2026, 1, 2), None, 5, True, False)
    assert files.read_company_registry(spark, tmp_path / "none.csv")[0].columns == list(files.REGISTRY)
    for name, columns, own in (("a", files.REGISTRY[:-1], flags), ("b", files.REGISTRY, flags | {"is_new_listing": "maybe"})):
        got, errors = files.read_company_registry(spark, registry_file(tmp_path / f"{name}.csv", columns, [{"symbol": "A", **own}]))
        assert got.count() == 0 and len(errors) == 1
    model = {"model_id": "m1", "model_scope": "symbol", "symbol": "NA", "model_version": "1.0", "model_status": "trained", "needs_retraining": "1"}
    got = files.read_model_registry(spark, registry_file(tmp_path / "m.csv", files.MODELS, [model, model | {"model_id": "m2", "model_scope": "master"}]))
    assert [(r["symbol"], r["model_version"], r["needs_retraining"]) for r in got.collect()] == [("NA", 1, True)] * 2
    assert files.read_model_registry(spark, tmp_path / "none.csv").count() == 0
    for bad in ({"model_scope": "all"}, {"model_status": "done"}, {"model_version": "x"}, {"needs_retraining": ""}, {"model_id": "m0"}):
        with pytest.raises(ValueError):
            files.read_model_registry(spark, registry_file(tmp_path / "x.csv", files.MODELS, [model | {"model_id": "m0"}, model | bad]))


def test_indices_are_refreshed_one_by_one(spark, tmp_path):
    assert files.read_index(spark, tmp_path / "none.csv").columns == list(files.INDEX)
    source = lambda code, *days: files.projected(spark.createDataFrame([(code, date(2026, 1, d), float(d), 5, datetime(2026, 2, 1)) for d in days], "index_code string, date date, value double, timestamp bigint, fetched_at timestamp_ntz"), files.INDEX, files.INDEX_TYPES)
    master, failed = files.refresh_indices(spark, str(tmp_path / "i"), {"A": lambda: source("A", 1, 2), "B": lambda: source("B", 2)})
    assert not failed and [(r["date"].day, r["index_code"]) for r in master.collect()] == [(1, "A"), (2, "A"), (2, "B")]
    master, failed = files.refresh_indices(spark, str(tmp_path / "i"), {"A": lambda: files.fetch(lambda u: (500, "", ""), "u", "json"), "B": lambda: source("B", 3)})
    assert list(failed) == ["A"] and sorted((r["index_code"], r["date"].day) for r in master.collect()) == [("A", 1), ("A", 2), ("B", 2), ("B", 3)]


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    files.write_by_symbol(spark.createDataFrame([("a/b",), ("c",)], "symbol string"), str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("part=*")} == {"part=a_b", "part=c"}
    files.export_csv(spark.createDataFrame([(date(2025, 1, 2),)], "date date"), str(tmp_path / "c"))
    assert "2025-01-02" in "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    with pytest.raises(ValueError):
        files.safe_component("..")
    for clash in (["a/b", "a_b"], [".."]):
        with pytest.raises(ValueError, match="safe name"):
            files.write_by_symbol(spark.createDataFrame([(c,) for c in clash], "symbol string"), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_upsert_and_ingest(spark, tmp_path):
    path = str(tmp_path / "i")
    schema = "index_code string, date date, value double, timestamp bigint, fetched_at timestamp_ntz"
    t = lambda h: datetime(2025, 1, 1, h)
    files.upsert_index(spark, path, spark.createDataFrame([("K", date(2025, 1, 1), 1.0, 5, t(1)), ("K", None, 1.0, 5, t(1))], schema))
    got = files.upsert_index(spark, path, spark.createDataFrame([("K", date(2025, 1, 1), 2.0, 5, t(3)), ("K", date(2025, 1, 1), 9.0, 7, t(2))], schema)).collect()
    assert [r["value"] for r in got] == [2.0]
    bars = "symbol string, date date, ldcp double, open double, high double, low double, close double, change double, change_percent double, volume bigint"
    rows = spark.createDataFrame([("A", date(2025, 1, 1), *[1.0] * 7, 5), ("A", date(2025, 1, 1), *[1.0] * 7, -5)], bars)
    assert files.write_ingest(rows, str(tmp_path / "v"), str(tmp_path / "r")) == (1, 1)
    assert spark.read.parquet(str(tmp_path / "v")).columns == rows.columns and "negative" in spark.read.parquet(str(tmp_path / "r")).first()["reason"]
    assert files.write_ingest(rows.limit(0), str(tmp_path / "v0"), str(tmp_path / "r0")) == (0, 0) and not (tmp_path / "r0").exists()
    assert files.write_ingest(rows.where("volume > 0"), str(tmp_path / "v1"), str(tmp_path / "r1")) == (1, 0) and not (tmp_path / "r1").exists()


def test_snapshots(spark, tmp_path):
    head = "symbol,company_name,security_type,officially_listed,official_status"
    (tmp_path / "listings.csv").write_text(f"{head}\n")
    (tmp_path / "listings_2026-07-01.csv").write_text(f"{head}\na ,x,etf,true,listed\n")
    (tmp_path / "listings_2026-07-02.csv").write_text(f"{head}\na,x,etf,true,listed\nA,x,etf,true,listed\n")
    rows, path = files.newest_snapshot(spark, tmp_path)
    assert path.endswith("07-01.csv") and rows.first()["symbol"] == "A"
    df = spark.createDataFrame([("TRUE ",), ("0",)], "x string")
    assert [r[0] for r in df.select(files.strict_boolean(F.col("x"))).collect()] == [True, False]
    assert [r[0] for r in df.select(files.lenient_boolean(F.col("x"), strip=False)).collect()] == [False, False]
    with pytest.raises(Exception, match="no boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(files.strict_boolean(F.col("x"))).collect()


def test_listings_are_refreshed_or_fall_back(spark, tmp_path):
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in ("Symbol", "Name", "Sector", "Clearing Type", "Shares", "Free Float", "Listed In", "Non-Compliance Reason")) + "</tr>"
    line = lambda s: f"<tr><td>{s}</td><td>Co, of {s}</td><td>S</td><td>T</td><td>1</td><td>-</td><td>ALL</td><td>late</td></tr>"
    schema = "page_id string, html string, board string, segment string, source string"
    pages = lambda: spark.createDataFrame([("a", head + line("NA") + line("B"), "main", "normal", "u1"), ("b", head + line("B"), "main", "dc", "u2")], schema)
    at = F.lit("2026-07-01 10:00:00").cast("timestamp_ntz")
    with pytest.raises(ValueError):
        files.refresh_listings(spark, tmp_path, lambda: pages().limit(0), at)
    rows, message, cached = files.refresh_listings(spark, tmp_path, pages, at)
    assert not cached and not message and sorted((r["symbol"], r["official_status"], r["company_name"]) for r in rows.collect()) == [("B", "non_compliant", "Co, of B"), ("NA", "listed", "Co, of NA")]
    rows, message, cached = files.refresh_listings(spark, tmp_path, lambda: 1 / 0, at)
    assert cached and "division" in message and rows.count() == 2


def test_fetch():
    assert files.fetch(lambda u: (200, "text/html; x", "<a>"), "u", "text/html") == "<a>"
    for bad in ((500, "text/html", "x"), (200, "image/png", "x"), (200, "text/html", " ")):
        with pytest.raises(ValueError):
            files.fetch(lambda u, bad=bad: bad, "u", "text/html")


def test_stream_takes_new_files_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(i, s, "f", date(2025, 1, 1), *[c] * 7, 1, 1, datetime(2025, 1, 1, h)) for i, s, c, h in r], ingest.BARS)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows((1, "A", 1.0, 1), (2, "B", 1.0, 1)).write.parquet(source)
    ingest.ingest_available(spark, source, target, checkpoint).awaitTermination()
    rows((3, "A", 2.0, 2), (4, "B", 0.5, 0)).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.ingest_available(spark, source, target, checkpoint).awaitTermination()
    assert {r["symbol"]: r["close"] for r in spark.read.parquet(target).collect()} == {"A": 2.0, "B": 1.0}
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out" / "date=2025-01-01").iterdir()}
    ingest.merge_batch(rows((5, "C", 3.0, 1)).withColumn("date", F.lit(date(2025, 1, 2))), target)
    ingest.merge_batch(rows((6, "D", 3.0, 1)).withColumn("date", F.lit(None).cast("date")), target)
    ingest.merge_batch(rows((7, "D", 4.0, 2)).withColumn("date", F.lit(None).cast("date")), target)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out" / "date=2025-01-01").iterdir()} == kept
    assert {r["symbol"]: r["close"] for r in spark.read.parquet(target).collect()} == {"A": 2.0, "B": 1.0, "C": 3.0, "D": 4.0}


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    os.symlink(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = ingest.windowed_activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="1000 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ingest.windowed_activity(spark.read.parquet(f"{sf}/events.parquet"))
    key = lambda rows: sorted((r["window_start"], r["event_type"], r["events"], round(r["total"], 6)) for r in rows)
    assert key(spark.table("windows").collect()) == key(batch.collect())
