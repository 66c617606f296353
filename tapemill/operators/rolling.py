"""Totals, averages and volatility over trailing calendar days, by block decomposition.

The days of a series are cut into blocks of the window's length. Within each block run a prefix sum and a suffix sum;
the trailing total that ends on a day is that day's prefix plus the suffix of the day after the window's start in the
block before. Each figure costs two additions whatever the window, sums of integers are exact, and, other than with
differences of one running sum, an outlier leaves no rounding error behind once it has left the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapemill.functions.text import finite, symbol_key
from tapemill.operators.bars import in_force
from tapemill.operators.slabs import compressed, group_ids, pieces, slab_map, values

WINDOWS = (7, 20, 30)
FIGURES = ("volume_total", "volume_ma", "sma", "rolling_volatility")


class Blocks:
    """The days of many series, each padded to whole blocks of ``n`` days with an empty block before.

    Sums are kept and may be asked for at any days, as often as wanted.
    """

    def __init__(self, n: int, span: np.ndarray):
        self.n = n
        length = n + -(-span // n) * n
        self.base = np.concatenate(([0], np.cumsum(length)[:-1])) + n
        self.size = int(length.sum())

    def sums(self, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix and suffix sums within the blocks, of ``x`` placed at ``at``."""
        days = np.zeros(self.size, x.dtype)
        days[at] = x
        block = days.reshape(-1, self.n)
        return np.cumsum(block, axis=1).ravel(), np.ascontiguousarray(np.cumsum(block[:, ::-1], axis=1)[:, ::-1]).ravel()

    def trailing(self, sums: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        """The sum over the ``n`` days that end at each ``wanted``: one prefix and one suffix."""
        prefix, suffix = sums
        return prefix[wanted] + np.where(wanted % self.n == self.n - 1, 0, suffix[wanted - self.n + 1])


def _schema(windows: tuple[int, ...]) -> str:
    return "symbol string, feed string, day int, " + ", ".join(f"{f}_{n} {'bigint' if f == 'volume_total' else 'double'}" for n in windows for f in FIGURES)


def _figures(table: pa.Table, starts: np.ndarray, windows: tuple[int, ...], dense: bool) -> Iterator[pa.Table]:
    n = table.num_rows
    gid = group_ids(starts, n)
    day = values(table, "day", int)
    close, volume = values(table, "close"), values(table, "volume", int)
    bar = values(table, "kind", int) == 0
    longest = max(windows)
    since, extent = compressed(starts, day, longest + 1)

    positive = np.flatnonzero(bar & (close > 0))
    same = gid[positive[1:]] == gid[positive[:-1]]
    later = positive[1:][same]
    change = close[later] / close[positive[:-1][same]] - 1
    known = np.flatnonzero(bar & ~np.isnan(close))
    bars = np.flatnonzero(bar)
    one = np.ones(n, np.int64)
    placed = {"volume": (bars, volume[bars]), "count": (known, one[known]), "close": (known, close[known]), "moves": (later, one[later]), "s1": (later, change), "s2": (later, change**2)}
    blocks = {}
    for w in windows:
        b = Blocks(w, extent + longest)
        blocks[w] = b, {k: b.sums(b.base[gid[rows]] + since[rows], x) for k, (rows, x) in placed.items()}

    # A row stands for its own day and, if dense, for those up to the next row; an asked one for its own day only.
    until = np.append(np.where(gid[1:] == gid[:-1], day[1:], day[:-1] + 1), day[-1:] + 1)
    for row, offset in pieces(until - day if dense else (~bar).astype(np.int64)):
        source = pa.array(row)
        out = {"symbol": table.column("symbol").take(source), "feed": table.column("feed").take(source), "day": pa.array((day[row] + offset).astype(np.int32))}
        place = since[row] + np.minimum(offset, longest)
        for w, (b, kept) in blocks.items():
            total = {k: b.trailing(x, b.base[gid[row]] + place) for k, x in kept.items()}
            with np.errstate(all="ignore"):
                sma = total["close"] / total["count"]
                deviation = np.sqrt(np.maximum(0, (total["s2"] - total["s1"] ** 2 / total["moves"]) / (total["moves"] - 1)))
            out[f"volume_total_{w}"] = pa.array(total["volume"])
            out[f"volume_ma_{w}"] = pa.array(total["volume"] / w)
            out[f"sma_{w}"] = pa.array(sma, mask=total["count"] == 0)
            out[f"rolling_volatility_{w}"] = pa.array(deviation, mask=total["moves"] < 2)
        yield pa.table(out)


def trailing_figures(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, at: DataFrame | None = None) -> DataFrame:
    """Figures of each series over the ``n`` calendar days that end on each day, for every n of ``windows``.

    Out come ``symbol`` (key form), ``feed``, ``date`` and for each n ``volume_total_n`` (null volumes as 0),
    ``volume_ma_n`` (that by n), ``sma_n`` (mean of the non-null closes, null without any) and ``rolling_volatility_n``
    (sample deviation of the simple returns whose later bar lies in the window, null below two; a return joins
    successive bars with a close above 0). Without ``at`` there is a row for each calendar day, active or not, from a
    series' first bar to its last; with ``at`` (symbol, feed, date) one for each of its rows, also for series without
    bars. Bars without a date are left out; repeated rows count once; an empty table gives an empty result.

    One shuffle reduces versions by (series, day); the second brings a series, then at most a row per calendar day,
    together. Gaps longer than the longest window are cut to it and output days are made a piece at a time, so that a task
    is bounded by rows whatever stray dates a series has.
    """
    rows = in_force(bars, ["close", "volume"]).select("symbol", "feed", F.unix_date("date").alias("day"), F.lit(0).alias("kind"), F.col("close").cast("double").alias("close"), F.col("volume").cast("long").alias("volume"))
    if at is not None:
        asked = at.where("date is not null").select(symbol_key("symbol").alias("symbol"), "feed", F.unix_date("date").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("long").alias("volume"))
        rows = rows.unionByName(asked)
    dense = at is None
    figures = slab_map(rows, ["symbol", "feed"], ["day", "kind"], lambda t, s: _figures(t, s, windows, dense), _schema(windows))
    return figures.withColumn("date", F.date_from_unix_date("day")).drop("day")


#: Stored figures and whether they must agree exactly.
STORED = {"sma_20": False, "volume_ma_20": False, "rolling_volatility_20": False, "volume_total_7": True, "volume_total_30": True}


def disagreeing_figures(bars: DataFrame, stored: DataFrame, relative: float = 1e-3, absolute: float = 1e-6) -> DataFrame:
    """Rows of ``stored`` with a figure that is wrongly null or not null, or off by more than both tolerances.

    Totals must agree exactly. The right figures are computed by :func:`trailing_figures` at the stored rows' days.
    """
    right = trailing_figures(bars, at=stored.select("symbol", "feed", "date").distinct())
    keyed = stored.where("date is not null").select(symbol_key("symbol").alias("k_symbol"), F.col("feed").alias("k_feed"), F.col("date").alias("k_date"), *[(finite(c) if not exact else F.col(c)).alias(f"s_{c}") for c, exact in STORED.items()])
    joined = keyed.join(right, keyed.k_symbol.eqNullSafe(right.symbol) & keyed.k_feed.eqNullSafe(right.feed) & (keyed.k_date == right.date))
    wrong = F.lit(False)
    for c, exact in STORED.items():
        s, r = F.col(f"s_{c}"), F.col(c)
        off = s != r if exact else (F.abs(s - r) > relative * F.abs(r)) & (F.abs(s - r) > absolute)
        wrong |= (s.isNull() != r.isNull()) | F.coalesce(off, F.lit(False))
    return joined.where(wrong).select("symbol", "feed", F.date_format("date", "yyyy-MM-dd").alias("bar_day"))
