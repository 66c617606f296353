"""Queries of the general training-data problems over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.functions.text import finite, reported, symbol_key, zoneless_micros
from tapemill.operators import asof, grid, history, profile, rejects, rolling, spikes


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.disagreeing_figures(_t(spark, d, "market_bars"), _t(spark, d, "indicators"))


def p1_figures(spark: SparkSession, d: str) -> DataFrame:
    """Trailing totals and averages of every series and calendar day."""
    right = rolling.trailing_figures(_t(spark, d, "market_bars"))
    return right.select("symbol", "feed", "date", "volume_total_7", "volume_total_30", *[F.round(c, 6).alias(c) for c in ("volume_ma_20", "sma_20", "rolling_volatility_20")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_rows(_t(spark, d, "market_bars")).select("bar_id", "field")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings with the first reason that holds."""
    return spikes.implausible_readings(_t(spark, d, "market_bars"))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """Readings within spikes of two or four days, which persist over the coarser levels."""
    return spikes.wavelet_cases(_t(spark, d, "market_bars")).where("reason = 'spike' and width > 1").select("symbol", "feed", "date", "field", "width")


def builds_as_known(builds: DataFrame, updates: DataFrame, observations: DataFrame) -> DataFrame:
    """Each build with what it recorded and ``known_*``, the values known at ``built_at``.

    ``build_id`` is unique. Attribute texts are in comparable form.
    """
    own = ["build_id", "market_context_included", "context_index_code", "context_value", "security_type", "officially_listed", "built_at"]
    told = builds.withColumns({"security_type": reported("security_type"), "built_at": zoneless_micros("built_at")})
    attributes = {"known_security_type": reported("security_type"), "known_officially_listed": F.col("officially_listed")}
    of_symbol = asof.known_at(
        told, own, symbol_key("symbol"), F.col("built_at"), updates, symbol_key("symbol"), history.iso_micros("registry_updated_at"), zoneless_micros("received_at"), F.col("update_id"), attributes
    )
    # Builds without context have no index to ask of.
    code = F.when(F.col("market_context_included"), F.upper(F.trim("context_index_code")))
    of_index = asof.known_at(
        of_symbol, [*own, *attributes], code, F.col("built_at"), observations, F.upper(F.trim("index_code")), F.unix_date("date").cast("long"), zoneless_micros("fetched_at"), F.col("timestamp"), {"known_context": finite("value")}, bounded=False, counted=told
    )
    return of_index.withColumns({"known_officially_listed": F.col("known_officially_listed").cast("boolean"), "known_context": F.col("known_context").cast("double")})


def p3_known(spark: SparkSession, d: str) -> DataFrame:
    """Every build with the attributes known at its time."""
    known = builds_as_known(_t(spark, d, "dataset_builds"), _t(spark, d, "registry_updates"), _t(spark, d, "index_observations"))
    return known.select("build_id", "known_security_type", "known_officially_listed", "known_context")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    known = builds_as_known(_t(spark, d, "dataset_builds"), _t(spark, d, "registry_updates"), _t(spark, d, "index_observations"))
    same = F.col("security_type").eqNullSafe(F.col("known_security_type")) & F.col("officially_listed").eqNullSafe(F.col("known_officially_listed"))
    context = F.coalesce("market_context_included", F.lit(False)) & ~finite("context_value").eqNullSafe(F.col("known_context"))
    return known.where(~same | context).select("build_id")


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every symbol's pair of states with its validity."""
    versions = history.status_history(_t(spark, d, "registry_updates"))
    seconds = lambda c: F.floor(F.col(c) / 1_000_000).alias(f"{c}_epoch")
    return versions.select("symbol", seconds("valid_from"), seconds("valid_to"), "official_status", "lifecycle_status")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_history(spark, d).select("symbol", "valid_from_epoch")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """One close or mark for every open day of every series' life."""
    return _grid(spark, d).withColumns({c: F.round(c, 4) for c in ("close", "support")})


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(_t(spark, d, "market_bars"), _t(spark, d, "trading_calendar"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("status <> 'observed'").select("symbol", "feed", F.date_format("date", "yyyy-MM-dd").alias("bar_day"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_t(spark, d, "raw_lines")).select("line_id", "reason")


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that load."""
    return rejects.load_strict(_t(spark, d, "raw_lines"))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Counts per file against the stated ones."""
    return rejects.rejects_by_file(_t(spark, d, "raw_lines"), _t(spark, d, "fetch_results"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_findings(_t(spark, d, "market_bars"), _t(spark, d, "market_loads"))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(_t(spark, d, "market_bars"), _t(spark, d, "market_loads"))


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each column of each load, rounded."""
    digits = {"null_rate": 6, "mean": 4, "deviation": 2, "standardised_difference": 4, "usual_difference": 4}
    return _profile(spark, d).withColumns({c: F.round(c, n) for c, n in digits.items()})


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """The profile's counts and moments, rounded."""
    return _profile(spark, d).select("load_id", "column_name", "rows", "nulls", "distinct_values", "pattern_violations", F.round("mean", 4).alias("mean"), F.round("deviation", 2).alias("deviation"))


QUERIES = {f.__name__: f for f in (p1_found, p1_figures, p2_found, p2_reasons, p2_wide, p3_found, p3_known, p4_found, p4_history, p5_found, p5_grid, p6_found, p6_rows, p6_files, p7_found, p7_profile, p7_rates)}
