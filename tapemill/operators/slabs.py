"""Group-wise numpy operators without one Python call per group.

``slab_map`` hash-partitions by the group keys, sorts, and hands *slabs* to a vectorised function: many whole groups at
once, as Arrow columns and group offsets. A group must have a bound of its own (here: a series has at most one row per
calendar day, or a group is a time shard); the memory of a task is one slab plus the group that is still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLAB_ROWS = 65_536


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets at which a new group begins; nulls are equal to each other."""
    n = table.num_rows
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.chunk(0)
        ids = codes.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(change)


def values(table: pa.Table, name: str, dtype=float) -> np.ndarray:
    """A column as floats with NaN for null, or as integers with 0 for null."""
    col = table.column(name)
    if dtype is float:
        return col.cast(pa.float64()).fill_null(np.nan).to_numpy()
    return col.cast(pa.int64()).fill_null(0).to_numpy()


def slab_map(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]],
    schema: str,
    slab_rows: int = SLAB_ROWS,
    clustered: bool = False,
) -> DataFrame:
    """Apply ``fn(table, starts)`` to slabs of whole groups sorted by ``keys`` and ``order``; it yields Arrow tables.

    ``clustered``: ``df`` ends in a window partitioned by ``keys``, whose exchange serves here too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, slab_rows
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            cut = int(starts[-1])
            if cut:
                for out in fn(table.slice(0, cut).combine_chunks(), starts[:-1]):
                    yield from out.to_batches(max_chunksize=slab_rows)
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
            else:
                held = table.combine_chunks().to_batches()
            enough = max(slab_rows, 2 * rows)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            for out in fn(table, group_starts(table, keys)):
                yield from out.to_batches(max_chunksize=slab_rows)

    placed = df if clustered else df.repartition(*keys)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def group_ids(starts: np.ndarray, n: int) -> np.ndarray:
    """The running number of the group of each row."""
    ids = np.zeros(n, np.int64)
    ids[starts[1:]] = 1
    return np.cumsum(ids)


def compressed(starts: np.ndarray, day: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of each group, sorted by day, with gaps beyond ``longest`` cut to it; and each group's extent.

    What happens within ``longest`` days of a row keeps its distances, and a slab's cells are bounded by its rows,
    whatever stray dates its groups hold.
    """
    step = np.minimum(np.diff(day, prepend=day[:1]), longest)
    step[starts] = 0
    place = np.cumsum(step)
    place -= np.repeat(place[starts], np.diff(np.append(starts, len(day))))
    ends = np.append(starts[1:], len(day)) - 1
    return place, place[ends] + 1


def pieces(many: np.ndarray, limit: int = 4 * SLAB_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number) of rows that each stand for ``many`` of them, numbered from 0, at most ``limit`` at a time."""
    upto = np.cumsum(many)
    total = int(upto[-1]) if len(upto) else 0
    for a in range(0, total, limit):
        b = min(a + limit, total)
        first, last = np.searchsorted(upto, (a, b - 1), side="right")
        here = many[first : last + 1].copy()
        here[-1] -= upto[last] - b
        here[0] -= a - (upto[first] - many[first])
        row = np.repeat(np.arange(first, last + 1), here)
        yield row, np.arange(a, b) - (upto - many)[row]


def segment_median(group: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    """Median of ``x`` by group (mean of the middle two); NaN for a group without values."""
    out = np.full(groups, np.nan)
    if len(x):
        by = np.lexsort((x, group))
        g, v = group[by], x[by]
        count = np.bincount(g, minlength=groups)
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        some = np.flatnonzero(count)
        out[some] = (v[first[some] + (count[some] - 1) // 2] + v[first[some] + count[some] // 2]) / 2
    return out
