"""As-of attributes (P3) and histories (P4) against brute force, and their edge cases."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapemill.operators.asof import DAY, PersistentTrees, known_at
from tapemill.operators.history import difference_snapshots, history_from_snapshots, status_history
from tapemill.operators.shards import Shards


def test_every_root_of_persistent_trees_stays():
    r = random.Random(5)
    for groups, most in ((1, 1), (3, 70), (5, 16)):
        group = np.repeat(np.arange(groups), [r.randint(1, most) for _ in range(groups)])
        leaf = np.concatenate([r.sample(range(n), n) for n in np.bincount(group)])
        trees = PersistentTrees(group, leaf)
        first = np.searchsorted(group, group)
        root = np.array([r.randint(-1, len(leaf) - 1) for _ in range(800)])
        upto = np.array([r.randint(-1, 80) for _ in range(800)])
        for t, u, got in zip(root, upto, trees.find(root, upto), strict=True):
            seen = leaf[first[t] : t + 1] if t >= 0 else leaf[:0]
            assert got == max(seen[seen <= u], default=-1)


def brute(events, reports, attribute, bounded=True):
    out = {}
    for event, entity, t in events:
        fit = [(v, k, tie, x) for e, v, k, tie, *values in reports if (x := values[attribute]) is not None and None not in (e, v, k) and e == entity and t is not None and k <= t and (v <= t or not bounded)]
        out[event] = max(fit)[3] if fit else None
    return out


def test_known_at_equals_brute_force(spark):
    r = random.Random(11)
    day = lambda: r.randint(0, 400) * DAY // 4
    names = ["A", "A", "A", "B", None, "C"]
    reports = [(r.choice(names), r.choice([day(), day(), None]), r.choice([day(), day(), day(), None]), i, r.choice(["x", "y", None]), r.choice(["1", None, None])) for i in range(500)]
    events = [(i, r.choice([*names, "D"]), r.choice([day(), day(), day(), None])) for i in range(300)]
    e = spark.createDataFrame(events, "id bigint, who string, t bigint").withColumn("known", F.lit("clash"))
    p = spark.createDataFrame(reports, "who string, valid bigint, known bigint, tie bigint, a string, b string").withColumn("shard", F.lit("clash"))
    for bounded, shard_rows, slab_rows in ((True, 20, 7), (False, 20, 7), (True, 10**6, 50), (False, 10**6, 10**6)):
        got = known_at(e, "id", F.col("who"), F.col("t"), p, F.col("who"), F.col("valid"), F.col("known"), F.col("tie"), {"a": F.col("a"), "b": F.col("b")}, bounded, shard_rows, slab_rows).collect()
        assert {g["id"]: g["a"] for g in got} == brute(events, reports, 0, bounded) and {g["id"]: g["b"] for g in got} == brute(events, reports, 1, bounded)
        assert len(got) == len(events)


def test_an_entity_with_half_of_the_rows_on_one_day(spark):
    r = random.Random(12)
    time = lambda hot: 50 * DAY + r.randint(0, DAY - 1) if hot else r.randint(0, 400) * DAY
    reports = [("HOT" if hot else f"E{i % 40}", time(hot) - r.choice([0, 0, 3 * DAY]), time(hot), i, r.choice(["x", "y", None])) for i in range(2000) for hot in (i % 2 == 0,)]
    events = [(i, "HOT" if i % 2 else f"E{i % 40}", time(i % 2)) for i in range(600)]
    e, p = spark.createDataFrame(events, "id bigint, who string, t bigint"), spark.createDataFrame(reports, "who string, valid bigint, known bigint, tie bigint, a string")
    ask = lambda rows: known_at(e, ["id", "who"], F.col("who"), F.col("t"), p, F.col("who"), F.col("valid"), F.col("known"), F.col("tie"), {"a": F.col("a")}, shard_rows=rows)
    assert {g["id"]: g["a"] for g in ask(100).collect()} == brute(events, reports, 0)
    told = [Shards([p.select(F.col("who").alias("entity"), F.col("known").alias("at"))], rows) for rows in (100, 10**6)]
    sizes = told[0].of(p.select(F.col("who").alias("entity"), F.col("known").alias("at"))).groupBy("entity", "shard").count().collect()
    assert sum(s["entity"] == "HOT" for s in sizes) >= 10 and max(s["count"] for s in sizes) <= 200 and told[1].none


def test_names_that_clash_are_refused(spark):
    e = spark.createDataFrame([(1, "A", 5)], "id bigint, a string, t bigint")
    with pytest.raises(ValueError, match="one name"):
        known_at(e, ["id", "a"], F.col("a"), F.col("t"), e, F.col("a"), F.col("t"), F.col("t"), F.col("t"), {"a": F.col("a")})


def test_known_at_of_empty_tables(spark):
    e = spark.createDataFrame([(1, "A", 5)], "id bigint, who string, t bigint")
    p = spark.createDataFrame([], "who string, valid bigint, known bigint, tie bigint, a string")
    ask = lambda e: known_at(e, "id", F.col("who"), F.col("t"), p, F.col("who"), F.col("valid"), F.col("known"), F.col("tie"), {"a": F.col("a")}).collect()
    assert [tuple(r) for r in ask(e)] == [(1, None)] and ask(e.limit(0)) == []


UPDATES = "update_id bigint, symbol string, official_status string, lifecycle_status string, registry_updated_at string, received_at timestamp_ntz, key string, n int"


def test_status_history(spark):
    rows = [
        (1, "ab ", None, None, "2025-01-01T05:00:00+05:00", "2025-01-02", "k", 0),  # the first update, nothing reported
        (2, "AB", "Listed", "newly listed", "2025-01-10T00:00:00Z", "2025-01-12", "k", 0),
        (3, "AB", "suspended", None, "2025-01-10T01:00:00+01:00", "2025-01-11", "k", 0),  # the same instant, received earlier
        (4, "Ab", " ", "newly-listed", "2025-02-20T00:00:00Z", "2025-02-20", "k", 0),  # nothing new
        (5, "AB", None, "suspended", "2025-06-01T00:00:00Z", "2025-01-01", "k", 0),
        (5, "AB", None, "suspended", "2025-06-01T00:00:00Z", "2025-01-01", "k", 0),  # a repeated row
        (6, "AB", "listed", None, "no time", "2025-01-01", "k", 0),
        (7, None, "listed", None, "2025-01-10T00:00:00Z", "2025-01-01", "k", 0),
    ]
    df = spark.createDataFrame(rows, UPDATES.replace("timestamp_ntz", "string")).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    got = sorted(tuple(r) for r in status_history(df).select("valid_from", "valid_to", "symbol", "change", "official_status", "lifecycle_status").collect())
    at = [1735689600, 1736467200, 1748736000]
    assert got == [(at[0] * 10**6, at[1] * 10**6, "AB", "inserted", None, None), (at[1] * 10**6, at[2] * 10**6, "AB", "changed", "listed", "newly_listed"), (at[2] * 10**6, None, "AB", "changed", "listed", "suspended")]
    assert status_history(df.limit(0)).count() == 0


def test_a_history_cut_into_shards_is_the_same(spark):
    r = random.Random(3)
    state = lambda: r.choice(["listed", "suspended", None, " "])
    rows = [(i, "HOT" if i % 2 else f"E{i % 30}", state(), state(), f"2025-{1 + i % 12:02d}-{1 + i // 12 % 28:02d}T{r.randint(0, 23):02d}:{r.choice([0, 30]):02d}:00Z" if i % 5 else "2025-06-01T09:00:00+05:00", "2025-01-01", "k", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, UPDATES.replace("timestamp_ntz", "string")).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    told = lambda n: sorted(map(tuple, status_history(df, n).collect()), key=str)
    whole = told(10**6)
    assert told(60) == whole and sum(x[0] == "HOT" for x in whole) > 100
    starts = {}
    for symbol, a, b, *_ in whole:
        starts.setdefault(symbol, []).append((a, b))
    for own in starts.values():
        own.sort()
        assert [b for _, b in own] == [*[a for a, _ in own[1:]], None]


def test_differences_are_null_safe(spark):
    now = spark.createDataFrame([(1, "a"), (None, None), (3, None), (4, "x")], "k int, a string")
    before = spark.createDataFrame([(1, "b"), (None, None), (2, None), (4, "x")], "k int, a string")
    got = {(r["k"], r["change"], r["a"], r["old_a"]) for r in difference_snapshots(now, before, ["k"], ["a"]).collect()}
    assert got == {(1, "changed", "a", "b"), (2, "deleted", None, None), (3, "inserted", None, None)}


def test_history_of_snapshots_with_deletion(spark):
    d = [date(2025, 1, 1), date(2025, 2, 1), date(2026, 3, 1), date(2026, 4, 1)]
    rows = [("x", d[0], 1), ("x", d[1], 1), ("x", d[3], 1), ("y", d[0], 1), ("y", d[1], 2), ("y", d[2], 2), ("y", d[3], 2), ("y", d[3], 1)]
    got = {(r["who"], r["valid_from"], r["valid_to"], r["a"]) for r in history_from_snapshots(spark.createDataFrame(rows, "who string, at date, a int"), "who", "at", ["a"]).collect()}
    assert got == {("x", d[0], d[2], 1), ("x", d[3], None, 1), ("y", d[0], d[1], 1), ("y", d[1], None, 2)}
