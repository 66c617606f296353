"""Irregular readings onto a regular grid by local polynomial regression with a compact kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapemill.functions.text import finite
from tapemill.operators.bars import arrival, in_force
from tapemill.operators.slabs import compressed, group_ids, pieces, slab_map, values

BANDWIDTH_DAYS = 10
LEAST_SUPPORT = 2.0
#: A calendar has one row per day; more days than this are no calendar.
MOST_DAYS = 400_000


def local_linear(y: np.ndarray, known: np.ndarray, bandwidth: int) -> tuple[np.ndarray, np.ndarray]:
    """Fit at each day and its effective support, from readings less than ``bandwidth`` days away.

    Readings are indexed by day, so that a fit touches only its kernel's days: the moments of the tricube-weighted
    straight line come from one shifted addition per day of the kernel, for all grid days at once.
    """
    n = len(y)
    s0, s1, s2, t0, t1, w2 = np.zeros((6, n))
    value = np.where(known, y, 0.0)
    mask = known.astype(float)
    for k in range(-bandwidth + 1, bandwidth):
        w = (1 - (abs(k) / bandwidth) ** 3) ** 3
        to, of = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
        m, v = w * mask[of], w * value[of]
        s0[to] += m
        s1[to] += k * m
        s2[to] += k * k * m
        t0[to] += v
        t1[to] += k * v
        w2[to] += w * m
    with np.errstate(all="ignore"):
        det = s0 * s2 - s1 * s1
        fit = np.where(det > 1e-9 * s0 * s0, (s2 * t0 - s1 * t1) / det, t0 / s0)
        return fit, np.where(w2 > 0, s0 * s0 / w2, 0.0)


def _grid(table: pa.Table, starts: np.ndarray, open_days: np.ndarray, bandwidth: int, least: float) -> Iterator[pa.Table]:
    n = table.num_rows
    gid = group_ids(starts, n)
    day, close = values(table, "day", int), values(table, "close")
    # In a gap of two bandwidths or more, what lies a bandwidth from either end has no reading near: one cell stands for it.
    since, extent = compressed(starts, day, 2 * bandwidth)
    base = np.concatenate(([0], np.cumsum(extent + bandwidth)[:-1]))
    y = np.full(int((extent + bandwidth).sum()), np.nan)
    y[base[gid] + since] = close
    fit, support = local_linear(y, y > 0, bandwidth)

    gap = np.append(np.where(gid[1:] == gid[:-1], np.diff(day), 1), 1)
    low = np.searchsorted(open_days, day)
    many = np.searchsorted(open_days, day + gap) - low
    for row, number in pieces(many):
        grid = open_days[low[row] + number]
        offset, left = grid - day[row], gap[row] - (grid - day[row])
        near = np.where(offset <= bandwidth, offset, np.maximum(bandwidth, np.minimum(gap[row], 2 * bandwidth) - left))
        at = base[gid[row]] + since[row] + near
        seen = ~np.isnan(y[at])
        filled = ~seen & (support[at] >= least)
        status = pa.array(["missing", "filled", "observed"]).take(pa.array(filled + 2 * seen))
        source = pa.array(row)
        yield pa.table({
            "symbol": table.column("symbol").take(source), "feed": table.column("feed").take(source), "day": pa.array(grid.astype(np.int32)), "status": status,
            "close": pa.array(np.where(seen, y[at], fit[at]), mask=~(seen | filled)), "support": pa.array(support[at]),
        })


def regular_grid(bars: DataFrame, calendar: DataFrame, bandwidth: int = BANDWIDTH_DAYS, least: float = LEAST_SUPPORT) -> DataFrame:
    """One row per series and open day of its life (first to last date of any row): symbol, feed, date, status, close,
    support.

    ``observed``: a row of the series has a non-null close that day (the latest such row's is given). ``filled``: the
    local regression has at least ``least`` effective readings within ``bandwidth`` days. ``missing``: too few, close
    is null. Closes of 0 or less are given where observed but never fitted from. Rows without a date are left out, an
    empty calendar or table gives an empty grid. The calendar's open days, one per day by nature and checked against
    ``MOST_DAYS``, travel with the task. Long gaps are cut short and output days are made a piece at a time, so that a task
    is bounded by rows whatever stray dates a series has.
    """
    days = [r[0] for r in calendar.where("is_open and date is not null").select(F.unix_date("date")).distinct().limit(MOST_DAYS + 1).collect()]
    if len(days) > MOST_DAYS:
        raise ValueError(f"a calendar of more than {MOST_DAYS} open days")
    open_days = np.array(sorted(days), np.int64)
    close = finite("close")
    rows = in_force(bars, [], {"close": F.max_by(close, F.when(close.isNotNull(), arrival(bars)))}).select("symbol", "feed", F.unix_date("date").alias("day"), F.col("close").cast("double").alias("close"))
    grid = slab_map(rows, ["symbol", "feed"], ["day"], lambda t, s: _grid(t, s, open_days, bandwidth, least), "symbol string, feed string, day int, status string, close double, support double")
    return grid.withColumn("date", F.date_from_unix_date("day")).drop("day")
