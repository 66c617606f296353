"""Canonical frames over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.functions.text import symbol_key
from tapemill.operators import quality
from tapemill.operators.dedup import keep_last

#: The keys of a reading: a series is a symbol of a feed.
SERIES = ["feed", "symbol", "date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of every feed as delivered, versions and faults included, with the symbol in key form."""
    return table(spark, d, "market_bars").withColumn("symbol", symbol_key("symbol"))


def series_days(spark: SparkSession, d: str) -> DataFrame:
    """The reading in force of each series and day, of equal times the one of the greatest ``bar_id``."""
    return keep_last(all_bars(spark, d).where("date is not null"), SERIES, ["ingested_at", "bar_id"])


def named_series(bars: DataFrame) -> DataFrame:
    """Each series under a symbol of its own, its feed and its symbol with a stroke between; nulls are backslash N."""
    name = lambda c: F.coalesce(c, F.lit("\\N"))
    return bars.withColumn("symbol", F.concat(name("feed"), F.lit("/"), name("symbol")))


def series_bars(spark: SparkSession, d: str) -> DataFrame:
    """The readings in force, each series as a symbol: symbol, date, open, high, low, close, volume, nulls and faults included."""
    return named_series(series_days(spark, d)).select("symbol", "date", "open", "high", "low", "close", "volume")


def sound_bars(spark: SparkSession, d: str) -> DataFrame:
    """Of the readings in force the valid ones, as ingest keeps them, each series as a symbol."""
    return quality.validate(named_series(series_days(spark, d)))[0].select("symbol", "date", "open", "high", "low", "close", "volume")


def index_series(spark: SparkSession, d: str) -> DataFrame:
    """Index observations, the last fetched of each code and date: index_code, date, value, volume, open."""
    rows = table(spark, d, "index_observations").where("date is not null")
    return keep_last(rows, ["index_code", "date"], ["fetched_at", "timestamp"]).select("index_code", "date", "value", "volume", "open")
