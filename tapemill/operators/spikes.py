"""Implausible readings by an undecimated Haar wavelet transform of each series.

The finest detail of a positive reading is the log ratio to the one before; a change in percent is such a detail as it
stands. Coarser details follow from finer ones: that of means over twice the readings is the sum of three, ``(d[-h] + 2
d[0] + d[h]) / 2``. Each level is scaled robustly, by the median size of the series' own non-zero details there. A spike
is an edge up and an edge down as far apart as it is wide, either of which persists over all levels up to its width; a run
of zero details shows a stuck sensor; bounds show impossible readings. A jump to a new level has one edge only and is no
spike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapemill.functions.text import symbol_key
from tapemill.operators.bars import in_force
from tapemill.operators.slabs import group_ids, segment_median, slab_map, values

FIELDS = ("close", "volume", "change_percent")
THRESHOLD = 10.0
STUCK_RUN = 5
#: Levels of the transform; level k is of means over 2 ** (k - 1) readings, the width of the spikes it shows.
LEVELS = 3
#: A coarser detail of this size is rounding.
ZERO = 1e-9


def finest_details(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Each reading less the one before, NaN at a series' start."""
    d = np.diff(x, prepend=np.nan)
    d[1:][group[1:] != group[:-1]] = np.nan
    return d


def details(finest: np.ndarray, group: np.ndarray, levels: int) -> list[np.ndarray]:
    """The details of each level, NaN where the means would reach beyond the series."""
    out = [finest]
    for k in range(1, levels):
        h = 1 << (k - 1)
        d = out[-1]
        after, before = np.full((2, len(d)), np.nan)
        if len(d) > h:
            same = group[h:] == group[:-h]
            after[:-h] = np.where(same, d[h:], np.nan)
            before[h:] = np.where(same, d[:-h], np.nan)
        coarse = (before + 2 * d + after) / 2
        out.append(np.where(np.abs(coarse) <= ZERO, 0.0, coarse))
    return out


def _limits(each: list[np.ndarray], group: np.ndarray, groups: int, threshold: float) -> list[np.ndarray]:
    out = []
    for d in each:
        size = np.abs(d)
        use = size > 0
        out.append(threshold * segment_median(group[use], size[use], groups)[group])
    return out


def spike_widths(finest: np.ndarray, group: np.ndarray, groups: int, threshold: float, levels: int, both_edges: bool) -> np.ndarray:
    """The least width of a spike that each reading is part of, 0 for none.

    ``both_edges``: as for levels of a quantity. Without, a reading is itself a change, and one edge makes a spike of it.
    """
    each = details(finest, group, levels)
    up = down = np.ones(len(finest), bool)
    width = np.zeros(len(finest), np.int8)
    for k, (d, limit) in enumerate(zip(each, _limits(each, group, groups, threshold), strict=True)):
        h = 1 << k
        with np.errstate(invalid="ignore"):
            up, down = up & (d > limit), down & (d < -limit)
        if not both_edges:
            width[(up | down) & (width == 0)] = h
            break
        start = np.zeros(len(finest), bool)
        start[:-h] = ((up[:-h] & down[h:]) | (down[:-h] & up[h:])) & (group[:-h] == group[h:]) if len(finest) > h else False
        for i in range(h):
            inside = np.roll(start, i)
            inside[:i] = False
            width[inside & (width == 0)] = h
    return width


def _stuck(x: np.ndarray, group: np.ndarray, volume: np.ndarray, least: int) -> np.ndarray:
    """Readings after the first of a run of ``least`` or more with zero detail, none at zero value or volume."""
    flat = np.zeros(len(x), bool)
    if len(x) > 1:
        live = (x != 0) & (volume != 0)
        flat[1:] = (x[1:] == x[:-1]) & (group[1:] == group[:-1]) & live[1:] & live[:-1]
    run = np.cumsum(~flat)
    return flat & (np.bincount(run)[run] >= least) if len(x) else flat


def _cases(table: pa.Table, starts: np.ndarray, threshold: float, least: int, levels: int) -> Iterator[pa.Table]:
    gid = group_ids(starts, table.num_rows)
    groups = len(starts)
    columns = {f: values(table, f) for f in FIELDS}
    bound = {"close": columns["close"] <= 0, "volume": columns["volume"] < 0, "change_percent": columns["change_percent"] < -100}
    for f in FIELDS:
        x = columns[f]
        reason, width = np.zeros((2, len(x)), np.int8)
        known = np.flatnonzero(~np.isnan(x))
        stuck = np.zeros(len(x), bool)
        stuck[known] = _stuck(x[known], gid[known], columns["volume"][known], least)
        reason[stuck] = 3
        change = f == "change_percent"
        some = known if change else np.flatnonzero(x > 0)
        finest = x[some] if change else finest_details(np.log(x[some]), gid[some])
        width[some] = spike_widths(finest, gid[some], groups, threshold, 1 if change else levels, not change)
        reason[width > 0] = 2
        reason[bound[f]] = 1
        hit = np.flatnonzero(reason)
        names = pa.array(["", "impossible", "spike", "stuck"])
        at = pa.array(hit)
        yield pa.table({
            "symbol": table.column("symbol").take(at), "feed": table.column("feed").take(at), "day": table.column("day").take(at), "field": pa.array([f] * len(hit), pa.string()), "reason": names.take(pa.array(reason[hit])),
            "width": pa.array(width[hit].astype(np.int32), mask=reason[hit] != 2), "stuck": pa.array(stuck[hit]),
        })


def wavelet_cases(bars: DataFrame, threshold: float = THRESHOLD, least: int = STUCK_RUN, levels: int = LEVELS) -> DataFrame:
    """(symbol, feed, date, field, reason, width, stuck) of each reading in force that its series cannot plausibly have shown.

    ``impossible``: close <= 0, volume < 0 or change_percent < -100. ``spike``: positive closes or volumes, ``width`` of
    them (1, 2, 4, ... of ``levels`` levels; the least that holds), between an edge up and an edge down, or the reverse: at
    every level up to the width's the details at both edges are larger than ``threshold`` times the series' median non-zero
    detail. At width 1 that is a reading above both, or below both, of its nearest dated positive neighbours (one at a
    series' end has no two neighbours and is none). A change_percent is a detail already: a spike, of width 1, is one
    larger in size than that many times the median non-zero size. ``stuck``: readings after the first in a run of ``least``
    or more equal, non-zero values, nulls skipped; a zero volume ends a run; the flag says so whatever the reason. The first
    reason that holds is given. Series with no non-zero move have no spikes; nulls are no readings.
    """
    rows = in_force(bars, list(FIELDS)).select("symbol", "feed", F.unix_date("date").alias("day"), *[F.col(f).cast("double") for f in FIELDS])
    cases = slab_map(rows, ["symbol", "feed"], ["day"], lambda t, s: _cases(t, s, threshold, least, levels), "symbol string, feed string, day int, field string, reason string, width int, stuck boolean")
    return cases.withColumn("date", F.date_from_unix_date("day")).drop("day")


def implausible_readings(bars: DataFrame, threshold: float = THRESHOLD, least: int = STUCK_RUN) -> DataFrame:
    """(symbol, feed, date, field, reason) of those :func:`wavelet_cases` that are impossible, stuck, or a spike of one reading.

    A reading that is part of a wider spike only is left to :func:`wavelet_cases`, where it has its width.
    """
    cases = wavelet_cases(bars, threshold, least).where("reason <> 'spike' or width = 1 or stuck")
    return cases.withColumn("reason", F.when((F.col("reason") == "spike") & (F.col("width") > 1), "stuck").otherwise(F.col("reason"))).drop("width", "stuck")


def implausible_rows(bars: DataFrame, threshold: float = THRESHOLD, least: int = STUCK_RUN) -> DataFrame:
    """(bar_id, field, reason) of every stored row, of whatever version, whose reading in force is a stated case.

    Cases are unique by (series, date, field) and few; the stored rows join them on the full key, so that Spark may
    broadcast the cases if it finds them small and split a hot key if not.
    """
    cases = implausible_readings(bars, threshold, least)
    rows = bars.where("date is not null").select("bar_id", symbol_key("symbol").alias("k_symbol"), F.col("feed").alias("k_feed"), F.col("date").alias("k_date"))
    on = F.col("k_symbol").eqNullSafe(F.col("symbol")) & F.col("k_feed").eqNullSafe(F.col("feed")) & (F.col("k_date") == F.col("date"))
    return rows.join(cases, on).select("bar_id", "field", "reason")
