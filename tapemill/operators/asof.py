"""Attributes as known at an event's time, from path-copied persistent search trees.

A tree holds an entity's reported values of one attribute by valid time. Every insertion, made in the order in which
the values became known, copies the path from the root and leaves earlier roots intact, so the root that was current
at an event's time is the tree as it was known then. An event finds its root by time and then the greatest valid-time
key it may use.

Trees are binary by the rank of their keys, so an insertion's copied path is known beforehand and all trees of a slab are
built level by level in arrays: a new node points to the path's new node below and to the other side's latest one.

An entity's rows come in time order and are taken a slab at a time. What earlier slabs, or earlier time shards of a large
entity (see :mod:`shards`), contribute is one row per attribute: the greatest key among values usable by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tapemill.operators.shards import DAY, SHARD_ROWS, Shards
from tapemill.operators.slabs import SLAB_ROWS, group_ids, group_starts, values

__all__ = ["DAY", "PersistentTrees", "known_at"]
_NEVER = -(2**62)
#: Events without entity or time have no answer and are spread over so many groups.
_LOST = 64


class PersistentTrees:
    """Search trees of many groups, each with a root after each of its insertions.

    ``group`` and ``leaf``, the key's rank within its group, are in order of insertion, groups one after the other. Node n of
    a level is the one that insertion n made there; -1 is no node.
    """

    def __init__(self, group: np.ndarray, leaf: np.ndarray):
        n = len(leaf)
        self.levels = int(leaf.max(initial=0)).bit_length()
        self._best = [leaf]
        self._children: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(n)
        for level in range(self.levels):
            side = (leaf >> level) & 1
            # Insertions into the same parent, in order; the latest one into either side is what the node points to.
            order = np.lexsort((at, leaf >> (level + 1), group))
            first = np.ones(n, bool)
            first[1:] = (group[order[1:]] != group[order[:-1]]) | (leaf[order[1:]] >> (level + 1) != leaf[order[:-1]] >> (level + 1))
            start = np.maximum.accumulate(np.where(first, at, 0)) if n else at
            child = []
            for s in (0, 1):
                latest = np.maximum.accumulate(np.where(side[order] == s, at, -1)) if n else at
                node = np.full(n, -1)
                some = latest >= start
                node[order[some]] = order[latest[some]]
                child.append(node)
            left, right = child
            self._children.append((left, right))
            below = self._best[-1]
            self._best.append(below[np.where(right >= 0, right, left)])

    def find(self, root: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The greatest rank not above ``upto`` in the tree of each ``root`` (a number of insertion); -1 for none."""
        node = np.where(upto >= 0, root, -1)
        found = np.full(len(root), -1)
        if not len(self._best[0]):
            return found
        upto = np.maximum(upto, 0)
        beyond = upto >> self.levels > 0
        upto = np.where(beyond, (1 << self.levels) - 1, upto)
        for level in range(self.levels - 1, -1, -1):
            left, right = self._children[level]
            here = node >= 0
            turn = here & ((upto >> level) & 1 == 1)
            lower = np.where(turn, left[node], -1)
            found = np.where(lower >= 0, self._best[level][lower], found)
            node = np.where(here, np.where(turn, right[node], left[node]), -1)
        return np.where(node >= 0, self._best[0][node], found)


def _ordinal(text: pa.ChunkedArray) -> np.ndarray:
    """The texts' places in order; nulls are -1."""
    coded = text.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    place = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), object))) if len(coded.dictionary) else np.zeros(0, np.int64)
    ids = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(ids >= 0, place[ids] if len(place) else -1, -1)


def _latest(group: np.ndarray, order: np.ndarray, asked_group: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked (group, time) the number of rows, sorted by (group, time), that are not after it."""
    times, code = np.unique(np.concatenate((order, asked)), return_inverse=True)
    width = len(times) + 1
    return np.searchsorted(group * width + code[: len(order)], asked_group * width + code[len(order) :], side="right")


def _answer(table: pa.Table, starts: np.ndarray, names: list[str], bounded: bool) -> tuple[list[pa.ChunkedArray], list[int | None]]:
    """The attributes' values for the events of whole groups, and the row of the last group's greatest key of each."""
    gid = group_ids(starts, table.num_rows)
    late = table.column("late").to_numpy().astype(bool)
    known, valid, key = (values(table, c, int) for c in ("known", "valid", "key"))
    events = np.flatnonzero(late)
    group = gid[events]
    out, greatest = [], []
    for i in range(len(names)):
        told = table.column(f"v{i}")
        rank = _ordinal(told)
        rows = np.flatnonzero(~late & (rank >= 0))
        by_key = rows[np.lexsort((rank[rows], key[rows], known[rows], valid[rows], gid[rows]))]
        leaf = np.zeros(table.num_rows, np.int64)
        leaf[by_key] = np.arange(len(by_key)) - np.searchsorted(gid[by_key], gid[by_key])
        inserted = rows[np.lexsort((leaf[rows], known[rows], gid[rows]))]
        trees = PersistentTrees(gid[inserted], leaf[inserted])
        base = np.searchsorted(gid[by_key], group)
        root = _latest(gid[inserted], known[inserted], group, known[events]) - 1
        root = np.where(root >= base, root, -1)
        upto = (_latest(gid[by_key], valid[by_key], group, known[events]) if bounded else np.searchsorted(gid[by_key], group, side="right")) - 1 - base
        found = trees.find(root, upto)
        out.append(told.take(pa.array(np.append(by_key, 0)[np.where(found >= 0, base + found, -1)], mask=found < 0)))
        last = np.flatnonzero(gid[by_key] == len(starts) - 1)
        greatest.append(int(by_key[last[-1]]) if len(last) else None)
    return out, greatest


def _carried(table: pa.Table, greatest: list[int | None]) -> pa.Table:
    """One row for each attribute that has a greatest key, with that attribute only."""
    rows = [table.slice(0, 0)]
    for i, r in enumerate(greatest):
        if r is not None:
            one = table.slice(r, 1)
            for j in range(len(greatest)):
                if j != i:
                    at = one.schema.get_field_index(f"v{j}")
                    one = one.set_column(at, one.schema.field(at), pa.nulls(1, one.schema.field(at).type))
            rows.append(one)
    return pa.concat_tables(rows)


def _answers(batches: Iterator[pa.RecordBatch], names: list[str], bounded: bool, schema: pa.Schema, slab_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (entity, shard) in time order, reports before events; a slab and a row per attribute are held."""
    held: list[pa.Table] = []

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.concat_tables(held).combine_chunks()
        found, greatest = _answer(table, group_starts(table, ["entity", "shard"]), names, bounded)
        event = table.column("event").filter(table.column("late"))
        for part in pa.Table.from_arrays([event, *found], names=["event", *names]).to_batches(max_chunksize=slab_rows):
            columns = [*part.column("event").flatten(), *part.columns[1:]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        # Of the open group only the greatest key of each attribute can still be an answer, besides what is yet to come.
        held = [_carried(table, greatest)]

    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= slab_rows:
            yield from settle()
            rows = 0
    if rows:
        yield from settle()


def known_at(
    events: DataFrame,
    keep: str | list[str],
    event_entity: Column,
    event_time: Column,
    reports: DataFrame,
    report_entity: Column,
    valid_time: Column,
    known_time: Column,
    tie: Column,
    attributes: dict[str, Column],
    bounded: bool = True,
    shard_rows: int = SHARD_ROWS,
    slab_rows: int = SLAB_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Each event's columns ``keep`` and, as text, the value of each attribute known at its time.

    That is the reported (non-null) one with the latest valid time, then latest known time, then greatest ``tie``,
    among the entity's reports with known time and, if ``bounded``, valid time not after the event's; null if none.
    Times are microseconds, ``tie`` a bigint. Reports without entity or time, and events without, have no part (the
    event's attributes come out null). Each event row is answered, repeated ones too. ``keep`` must not name an attribute.

    One shuffle brings an entity's reports and events together. Where an entity holds more than ``shard_rows`` of them
    its time line is cut; what each shard takes over from earlier ones are its attributes' greatest keys.
    """
    names, keep = list(attributes), [keep] if isinstance(keep, str) else list(keep)
    if clash := set(names) & set(keep):
        raise ValueError(f"columns and attributes of one name: {sorted(clash)}")
    asked = events.select(event_entity.cast("string").alias("entity"), event_time.alias("known"), F.struct(*keep).alias("event"))
    lost = F.col("entity").isNull() | F.col("known").isNull()
    told = reports.select(report_entity.cast("string").alias("entity"), valid_time.cast("long").alias("valid"), known_time.alias("known"), tie.cast("long").alias("key"), *[c.cast("string").alias(f"v{i}") for i, c in enumerate(attributes.values())])
    # A report may be an answer from the later of its times on.
    told = told.where("entity is not null and valid is not null and known is not null").withColumn("at", F.greatest("valid", "known") if bounded else F.col("known"))
    asked = asked.withColumn("at", F.col("known"))
    sizes = asked if counted is None else counted.select(event_entity.cast("string").alias("entity"), event_time.alias("known")).withColumn("at", F.col("known"))
    shards = Shards([told, sizes.where(~lost)], shard_rows)
    told = shards.of(told)

    empty = {"valid": "bigint", "key": "bigint", **{f"v{i}": "string" for i in range(len(names))}}
    questions = shards.of(asked).withColumns({**{c: F.lit(None).cast(kind) for c, kind in empty.items()}, "late": F.lit(True), "shard": F.when(lost, F.pmod(F.xxhash64("event"), F.lit(_LOST)).cast("int") - _LOST).otherwise(F.col("shard"))})
    questions = questions.withColumns({"entity": F.when(~lost, F.col("entity")), **{c: F.coalesce(c, F.lit(_NEVER)) for c in ("known", "at")}})
    no_event = F.lit(None).cast(asked.schema["event"].dataType)
    order = ["entity", "shard", "at", "late", "known", "valid", "key", *[f"v{i}" for i in range(len(names))], "event"]
    rows = questions.select(order).unionByName(told.withColumns({"late": F.lit(False), "event": no_event}).select(order))
    if not shards.none:
        best = [F.max(F.when(F.col(f"v{i}").isNotNull(), F.struct("valid", "known", "key", F.col(f"v{i}").alias("value")))).alias(f"b{i}") for i in range(len(names))]
        each = shards.every().join(told.where("large").groupBy("entity", "shard").agg(*best), ["entity", "shard"], "left")
        past = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        before = each.select("entity", "shard", *[F.max(f"b{i}").over(past).alias(f"b{i}") for i in range(len(names))])
        for i in range(len(names)):
            b = F.col(f"b{i}")
            of = {"entity": F.col("entity"), "shard": F.col("shard"), "at": F.lit(_NEVER), "late": F.lit(False), "known": b["known"], "valid": b["valid"], "key": b["key"], **{f"v{j}": b["value"] if i == j else F.lit(None).cast("string") for j in range(len(names))}, "event": no_event}
            rows = rows.unionByName(before.where(b.isNotNull()).select(*[c.alias(k) for k, c in of.items()]))
    schema = StructType([*asked.schema["event"].dataType.fields, *[StructField(a, StringType()) for a in names]])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    placed = rows.repartition("entity", "shard").sortWithinPartitions("entity", "shard", "at", "late")
    return placed.mapInArrow(lambda it: _answers(it, names, bounded, arrow, slab_rows), schema)
