"""Row validation and fatal faults per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapemill.functions.text import finite

REQUIRED = ("symbol", "date", "ldcp", "open", "high", "low", "close", "change", "change_percent", "volume")
OHLCV = ("open", "high", "low", "close", "volume")


def _missing(df: DataFrame, c: str) -> Column:
    return (finite(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)).isNull()


def validation_reasons(df: DataFrame) -> Column:
    """All faults of a daily record, joined by "; " in fixed order; empty for a valid one."""
    tests = [F.when(_missing(df, c), f"{c} is missing") for c in REQUIRED]
    tests += [F.when(F.trim("symbol") == "", "symbol is empty"), F.when(F.col("high") < F.col("low"), "high is lower than low"), F.when(F.col("volume") < 0, "volume is negative")]
    return F.concat_ws("; ", *tests)


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reason``) of one classified frame."""
    classified = df.withColumn("reason", validation_reasons(df))
    return classified.where("reason = ''").drop("reason"), classified.where("reason <> ''")


def fatal_errors(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, errors), after the further keys ``by``, of symbols that cannot be used, their faults joined by "; " in fixed order.

    Rows whose symbol is null or blank come out under ``<missing>``. Null dates are invalid, and repeat each other.
    """
    symbol = F.trim("symbol")
    named = bars.withColumn("symbol", F.when(symbol != "", symbol))
    absent = F.lit(False)
    for c in OHLCV:
        absent |= _missing(bars, c)
    negative = F.lit(False)
    for c in OHLCV[:4]:
        negative |= F.coalesce(finite(c) <= 0, F.lit(False))
    # By day first: then a symbol's repeated dates are known without a distinct over the whole of it.
    days = named.groupBy(*by, "symbol", "date").agg(F.count("*").alias("n"), F.bool_or(absent).alias("absent"), F.bool_or(F.coalesce(finite("high") < finite("low"), F.lit(False))).alias("crossed"), F.bool_or(F.coalesce(F.col("volume") < 0, F.lit(False))).alias("short"), F.bool_or(negative).alias("negative"))
    faults = days.groupBy(*by, "symbol").agg(
        F.concat_ws("; ", F.when(F.bool_or(F.col("date").isNull()), "invalid trading date"), F.when(F.bool_or("absent"), "missing or invalid OHLCV value"), F.when(F.bool_or(F.col("n") > 1), "duplicate trading date"),
                    F.when(F.bool_or("crossed"), "high is lower than low"), F.when(F.bool_or("short"), "volume is negative"), F.when(F.bool_or("negative"), "price is not positive")).alias("errors")
    )
    return faults.select(*by, F.coalesce("symbol", F.lit("<missing>")).alias("symbol"), F.when(F.col("symbol").isNull(), "symbol is empty").otherwise(F.col("errors")).alias("errors")).where("errors <> ''")


def dataset_summary(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: rows, symbols, first and last date, invalid dates, blank symbols, missing columns and whether valid."""
    lacking = [c for c in required if c not in df.columns]
    has = lambda c: c in df.columns
    symbol = F.trim("symbol") if has("symbol") else F.lit(None).cast("string")
    date = F.col("date") if has("date") else F.lit(None).cast("date")
    out = df.agg(F.count("*").alias("rows"), F.count_distinct(F.when(symbol != "", symbol)).alias("symbols"), F.min(date).alias("earliest_date"), F.max(date).alias("latest_date"), F.count_if(date.isNull()).alias("invalid_dates"), F.count_if(F.coalesce(symbol, F.lit("")) == "").alias("blank_symbols"))
    return out.withColumns({"missing_columns": F.lit(", ".join(lacking)), "valid": F.lit(not lacking) & (F.col("rows") > 0) & (F.col("invalid_dates") == 0) & (F.col("blank_symbols") == 0)})
