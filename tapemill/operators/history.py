"""Histories of changing attributes by differencing consecutive snapshots.

Snapshot n of an entity and snapshot n - 1 meet in a null-safe full outer join, which classifies each as inserted,
changed or deleted; the union of the change events gets its validity by lead. Of an entity with very many updates (see
:mod:`shards`) no window sees the whole: they run over (entity, time shard), and what crosses a shard's border (running
number, last reported value, next event) is carried by one row per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapemill.functions.text import iso_micros, reported, symbol_key, zoneless_micros
from tapemill.operators.shards import SHARD_ROWS, Shards


def states_from_updates(updates: DataFrame, attributes: dict[str, Column], key: Column, instant: Column, received: Column, tie: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, Shards]:
    """(entity, n, at, shard, attributes...): the state of each key after each of its instants, numbered from 1; and its shards.

    Of updates of a key at one instant only the one received last counts (then the greatest ``tie``, then the greatest
    attributes). A null attribute keeps the earlier value. Updates without key or instant are left out. ``instant`` is in
    microseconds. One shuffle and one sort serve all windows.
    """
    names = list(attributes)
    rows = updates.select(key.alias("entity"), instant.alias("at"), received.alias("received"), F.col(tie).alias("tie"), *[c.alias(a) for a, c in attributes.items()]).where("entity is not null and at is not null")
    shards = Shards([rows], shard_rows)
    line = Window.partitionBy("entity", "shard").orderBy("at", "received", "tie", *names)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    last = shards.of(rows).withColumn("following", F.lead("at").over(line)).where("following is null or following <> at")
    states = last.withColumns({"n": F.row_number().over(line).cast("long"), **{a: F.last(a, ignorenulls=True).over(upto) for a in names}})
    if not shards.none:
        ends = states.where("large").groupBy("entity", "shard").agg(F.max("n").alias("many"), F.max_by(F.struct(*names), "at").alias("end"))
        before = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        each = shards.every().join(ends, ["entity", "shard"], "left")
        carried = each.select(F.col("entity").alias("c_entity"), F.col("shard").alias("c_shard"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("earlier"), *[F.last(F.col("end")[a], ignorenulls=True).over(before).alias(f"c_{a}") for a in names])
        states = states.join(carried, (F.col("entity") == F.col("c_entity")) & (F.col("shard") == F.col("c_shard")), "left")
        states = states.withColumns({"n": F.col("n") + F.coalesce("earlier", F.lit(0)), **{a: F.coalesce(a, f"c_{a}") for a in names}})
    return states.select("entity", "n", "at", "shard", "large", *names), shards


def difference_snapshots(now: DataFrame, before: DataFrame, keys: list[str], attributes: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``change`` (inserted, changed, deleted) and the attributes after (``a``) and before (``old_a``).

    ``carried`` columns of ``now`` come along and are not compared.

    A null-safe full outer join; unchanged keys do not come out. A deleted key has null attributes after. Keys must be
    unique in either snapshot.
    """
    left = now.select(*[F.col(k).alias(f"n_{k}") for k in keys], *attributes, *carried, F.lit(True).alias("is_now"))
    right = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(a).alias(f"old_{a}") for a in attributes], F.lit(True).alias("was"))
    on = F.lit(True)
    same = F.lit(True)
    for k in keys:
        on &= F.col(f"n_{k}").eqNullSafe(F.col(f"b_{k}"))
    for a in attributes:
        same &= F.col(a).eqNullSafe(F.col(f"old_{a}"))
    change = F.when(F.col("was").isNull(), "inserted").when(F.col("is_now").isNull(), "deleted").when(~same, "changed")
    joined = left.join(right, on, "full_outer")
    return joined.select(*[F.when(F.col("is_now"), F.col(f"n_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys], change.alias("change"), *carried, *attributes, *[f"old_{a}" for a in attributes]).where("change is not null")


def history_from_states(states: DataFrame, shards: Shards, attributes: list[str]) -> DataFrame:
    """(entity, valid_from, valid_to, change, attributes..., old...) of numbered states, see :func:`states_from_updates`."""
    earlier = states.select("entity", (F.col("n") + 1).alias("n"), *attributes)
    changes = difference_snapshots(states, earlier, ["entity", "n"], attributes, ("at", "shard", "large"))
    # A key without a later state was not deleted: updates report, they do not list what exists.
    events = changes.where("change <> 'deleted'").withColumn("valid_to", F.lead("at").over(Window.partitionBy("entity", "shard").orderBy("at")))
    if not shards.none:
        firsts = shards.every().join(events.where("large").groupBy("entity", "shard").agg(F.min("at").alias("first")), ["entity", "shard"], "left")
        after = Window.partitionBy("entity").orderBy("shard").rowsBetween(1, Window.unboundedFollowing)
        following = firsts.select(F.col("entity").alias("f_entity"), F.col("shard").alias("f_shard"), F.min("first").over(after).alias("following"))
        events = events.join(following, (F.col("entity") == F.col("f_entity")) & (F.col("shard") == F.col("f_shard")), "left").withColumn("valid_to", F.coalesce("valid_to", "following"))
    return events.select("entity", F.col("at").alias("valid_from"), "valid_to", "change", *attributes, *[f"old_{a}" for a in attributes])


def history_from_snapshots(snapshots: DataFrame, key: str, period: str, attributes: list[str]) -> DataFrame:
    """The history of full periodic snapshots, where a key missing from the next snapshot was deleted.

    ``valid_to`` of a version is the period of the change that ended it. Of rows with equal key and period one is kept
    (the greatest attributes). Periods are dates; rows without one are left out. Null keys are a key of their own.
    """
    rows = snapshots.where(F.col(period).isNotNull()).groupBy(F.col(key).alias("key"), F.col(period).alias("period")).agg(F.max(F.struct(*attributes)).alias("s")).select("key", "period", "s.*")
    # One row per snapshot, however many rows they hold: the only window without keys.
    periods = rows.select("period").distinct()
    order = Window.orderBy("period")
    following = periods.select(F.col("period").alias("p"), F.lead("period").over(order).alias("next_period"))
    shifted = rows.join(following, F.col("period") == F.col("p")).where("next_period is not null").select("key", F.col("next_period").alias("period"), *attributes)
    changes = difference_snapshots(rows, shifted, ["key", "period"], attributes).withColumnRenamed("period", "valid_from")
    # A key has at most one event per snapshot.
    ended = changes.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")))
    return ended.where("change <> 'deleted'").withColumnRenamed("key", key)


def status_history(updates: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The history of (official_status, lifecycle_status) of each symbol of the registry's updates.

    symbol (key form), valid_from, valid_to (microseconds since 1970, null while in force), change, the pair in
    comparable form and the pair before. Times are those of ``registry_updated_at``; updates whose time does not parse
    are left out, null and blank attributes keep the earlier value, repeated reports change nothing.
    """
    pair = ["official_status", "lifecycle_status"]
    states, shards = states_from_updates(updates, {a: reported(a) for a in pair}, symbol_key("symbol"), iso_micros("registry_updated_at"), zoneless_micros("received_at"), "update_id", shard_rows)
    return history_from_states(states, shards, pair).withColumnRenamed("entity", "symbol")
