"""Filters, orders, pages, summaries and set operations on market data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapemill.session import durable


def filter_market(bars: DataFrame, symbol: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows of a symbol within inclusive dates; a start after the end raises."""
    if start and end and start > end:
        raise ValueError("start after end")
    out = bars if symbol is None else bars.where(F.col("symbol") == symbol)
    out = out if start is None else out.where(F.col("date") >= F.lit(start))
    return out if end is None else out.where(F.col("date") <= F.lit(end))


def security_history(bars: DataFrame, symbol: str) -> DataFrame:
    if not symbol.strip():
        raise ValueError("no symbol")
    return filter_market(bars, symbol.strip())


def history_period(bars: DataFrame, months: int | None, reference: date | None = None) -> DataFrame:
    """Rows at most ``months`` before the reference, by default the latest date, and not after it; None keeps all."""
    if months is None:
        return bars
    if reference is None:
        one = bars.agg(F.max("date").alias("_ref"))  # one row
        return bars.join(F.broadcast(one), F.col("date").between(F.add_months("_ref", -months), F.col("_ref"))).drop("_ref")
    return bars.where(F.col("date").between(F.add_months(F.lit(reference), -months), F.lit(reference)))


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """Adds each row's place in a total order, from 1.

    Rows are sorted by range and numbered within their partition; a partition's offset is the count of those before,
    so that no one task sees the whole table. ``order`` must be total. The sorted rows are checkpointed: their partitions
    are looked at twice and must not move in between.
    """
    held = durable(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    parts = held.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(offsets, F.shiftright("_m", 33) == F.col("_p")).withColumn(name, place).drop("_m", "_p", "_before")


def page_bounds(total: int, size: int, page: object) -> tuple[int, int, int, int]:
    """(page, pages, first, last): the page clamped, a page that is no whole number is 1, a bad size raises."""
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ValueError("page size must be a positive whole number")
    pages = max(1, -(-total // size))
    wanted = page if isinstance(page, int) and not isinstance(page, bool) else 1
    wanted = min(max(1, wanted), pages)
    return wanted, pages, min(total, (wanted - 1) * size + 1), min(total, wanted * size)


def paginate(df: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page in a total order; Spark keeps only the rows up to the page's end while sorting."""
    at, _, _, _ = page_bounds(df.count(), size, page)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)


def tail(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (descending for the last ones)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def summary(bars: DataFrame) -> DataFrame:
    """One row: distinct dates, distinct non-blank symbols, rows, first and last date."""
    s = F.trim("symbol")
    return bars.agg(F.count_distinct("date").alias("trading_days"), F.count_distinct(F.when(s != "", s)).alias("symbols"), F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) of every column, most nulls first; NaN is null. One pass."""
    bad = lambda c, t: F.count_if(F.col(c).isNull() | F.isnan(c)) if t in ("double", "float") else F.count_if(F.col(c).isNull())
    wide = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), bad(c, t).alias("nulls")) for c, t in df.dtypes]).alias("a"))
    return wide.select(F.inline("a")).orderBy(F.desc("nulls"), "column_name")


def history_lengths(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row on the row counts of symbols, or of series by the further keys ``by``: symbols, mean, sample deviation, least, quartiles, greatest."""
    n = bars.groupBy(*by, "symbol").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("symbols"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("deviation"), F.min("n").alias("least"), *[F.percentile("n", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.max("n").alias("greatest"))


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-blank values in order."""
    return df.select(F.trim(column).alias(column)).where(f"{column} <> ''").distinct().orderBy(column)


def merged_selection(current: list[str], visible: list[str], chosen: list[str], allowed: list[str]) -> list[str]:
    """What was selected out of view stays, what is visible is as chosen; in the allowed list's order."""
    keep = (set(current) - set(visible)) | (set(chosen) & set(visible))
    return [s for s in allowed if s in keep]
