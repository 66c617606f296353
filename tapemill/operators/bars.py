"""The reading in force of each series and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapemill.functions.text import finite, symbol_key

#: A version without a time of arrival is older than any other.
BEFORE_ALL = "0001-01-01 00:00:00"


def arrival(bars: DataFrame) -> Column:
    kind = dict(bars.dtypes)["ingested_at"]
    return F.coalesce(F.col("ingested_at"), F.lit(BEFORE_ALL).cast(kind))


def in_force(bars: DataFrame, fields: list[str], always: dict[str, Column] | None = None) -> DataFrame:
    """One row per (symbol in key form, feed, date): ``fields`` of the version with the greatest ``ingested_at``.

    Rows without a date are no readings and are left out; null symbols or feeds form a series of their own; NaN is
    null. Versions with equal times agree by contract. ``always`` adds further aggregates over all versions. The key
    holds the date, so a series that holds a third of all rows is still spread over tasks, versions are reduced before
    the shuffle, and what is left of a series has at most one row per calendar day.
    """
    types = dict(bars.dtypes)
    when = arrival(bars)
    picked = [F.max_by(finite(f) if types[f] in ("double", "float") else F.col(f), when).alias(f) for f in fields]
    keyed = bars.where("date is not null").withColumn("symbol", symbol_key("symbol"))
    return keyed.groupBy("symbol", "feed", "date").agg(*picked, *[c.alias(k) for k, c in (always or {}).items()])
