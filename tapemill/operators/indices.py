"""Index changes, context, performance, metrics and health; market breadth and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapemill.functions.text import finite
from tapemill.operators.indicators import guarded

#: Index codes, display labels, and the weights of either health score.
INDEX_CODES = ("KSE100", "KSE30", "KMI30", "ALLSHR")
INDEX_WEIGHTS = {"1-day direction": 10, "5-trading-day return": 15, "20-trading-day return": 20, "Value relative to SMA-20": 15, "Value relative to SMA-50": 15, "Short-term momentum": 10, "Rolling volatility penalty": 10, "Volume participation": 5}
MARKET_WEIGHTS = {"KSE100 trend": 15, "KSE30 trend": 10, "KMI30 trend": 10, "All Share trend": 15, "Advance/decline ratio": 15, "Advancing securities": 10, "Volume participation": 10, "Moving-average position": 10, "Volatility penalty": 5}
#: The market's context by date, in the order of a dataset's columns.
CONTEXT = ("kse100_value", "kse100_return_1d", "kse100_return_5d", "kse100_volatility_20", "kse30_value", "kse30_return_1d", "kmi30_value", "kmi30_return_1d", "allshr_value", "allshr_return_1d", "market_advance_decline_ratio", "market_advancing_percent", "market_health_score")
LADDER = {"one_week_return": 5, "one_month_return": 21, "three_month_return": 63, "six_month_return": 126, "one_year_return": 252}
PERIOD_MONTHS = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12}


def daily_changes(series: DataFrame) -> DataFrame:
    """Adds daily_change and daily_change_percent per index_code by date."""
    prior = F.lag("value").over(Window.partitionBy("index_code").orderBy("date"))
    return series.withColumns({"daily_change": F.col("value") - prior, "daily_change_percent": F.try_divide(F.col("value") - prior, prior) * 100})


def range_filter(series: DataFrame, period: str, key: str = "date") -> DataFrame:
    """Rows within ``period`` (1M, 3M, 6M, 1Y, Maximum) before the latest date of all indices; null dates drop."""
    dated = series.where(F.col(key).isNotNull())
    if period not in PERIOD_MONTHS:
        if period not in ("Maximum", "All"):
            raise ValueError(f"unknown period {period}")
        return dated
    latest = dated.agg(F.max(key).alias("_latest"))  # one row
    return dated.join(F.broadcast(latest), F.col(key) >= F.add_months("_latest", -PERIOD_MONTHS[period])).drop("_latest")


def year_to_date(series: DataFrame) -> DataFrame:
    """Rows of the latest date's calendar year."""
    latest = series.agg(F.max("date").alias("_latest"))  # one row
    return series.join(F.broadcast(latest), F.col("date") >= F.trunc("_latest", "year")).drop("_latest")


def normalized(series: DataFrame) -> DataFrame:
    """(index_code, date, performance): value by the first value, times 100; series with a first value of 0 drop."""
    w = Window.partitionBy("index_code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    based = series.where("date is not null and value is not null").withColumn("_base", F.first("value").over(w))
    return based.where("_base <> 0").select("index_code", "date", (F.col("value") / F.col("_base") * 100).alias("performance"))


def single_index(series: DataFrame, code: str, label: str) -> DataFrame:
    """(date, index, value) of one index under its label, in order; rows without date or value drop (M5)."""
    rows = series.where((F.col("index_code") == code) & F.col("date").isNotNull()).select("date", F.lit(label).alias("index"), finite(F.col("value").try_cast("double")).alias("value"))
    return rows.where("value is not null").orderBy("date")


def context(series: DataFrame) -> DataFrame:
    """One row per date with each index's value and returns (M6): one grouping in place of a chain of outer joins.

    KSE100 has 1- and 5-observation returns and a 20-observation population deviation of the former, the others a
    1-observation return. The per-date breadth and health columns are declared and null.
    """
    w = Window.partitionBy("index_code").orderBy("date")
    back = lambda n: F.try_divide(F.col("value"), F.lag("value", n).over(w)) - 1
    rows = series.withColumns({"r1": back(1), "r5": back(5)})
    rows = rows.withColumn("v20", guarded(F.stddev_pop("r1"), F.col("r1"), 20, w.rowsBetween(-19, 0)))
    of = lambda code, c: F.max(F.when(F.col("index_code") == code, F.col(c)))
    columns = [of("KSE100", "value").alias("kse100_value"), of("KSE100", "r1").alias("kse100_return_1d"), of("KSE100", "r5").alias("kse100_return_5d"), of("KSE100", "v20").alias("kse100_volatility_20")]
    for code in INDEX_CODES[1:]:
        columns += [of(code, "value").alias(f"{code.lower()}_value"), of(code, "r1").alias(f"{code.lower()}_return_1d")]
    wide = rows.groupBy("date").agg(*columns)
    return wide.withColumns({c: F.lit(None).cast("double") for c in ("market_advance_decline_ratio", "market_advancing_percent", "market_health_score")})


def metrics(series: DataFrame) -> DataFrame:
    """One row per index_code: latest, previous, changes, the return ladder, year to date, volatility, moving averages
    and volume (W21-W25).

    Rows without date or value drop; dates are taken as they are (deduplicate first). Figures without enough
    observations, or on a base of 0, are null; with one observation the longest return is 0.
    """
    rows = series.where("date is not null and value is not null and not isnan(value)")
    by = Window.partitionBy("index_code")
    newest = by.orderBy(F.col("date").desc())
    ordered = rows.withColumns({"rn": F.row_number().over(newest), "prior": F.lead("value").over(newest)})
    ordered = ordered.withColumns({"r": F.try_divide(F.col("value"), F.col("prior")) - 1, "latest": F.max("date").over(by)})
    at = lambda k, c="value": F.max(F.when(F.col("rn") == k, F.col(c)))
    upto = lambda n, x: F.when(F.col("rn") <= n, x)
    change = lambda a, b: (F.try_divide(a, b) - 1) * 100
    this_year = F.col("date") >= F.trunc("latest", "year")
    wide = ordered.groupBy("index_code").agg(
        F.count("*").alias("observations"), F.max("date").alias("latest_date"), at(1).alias("latest_value"), at(2).alias("previous_value"), at(1, "volume").alias("latest_volume"),
        *[at(n + 1).alias(f"_{k}") for k, n in LADDER.items()], F.min_by("value", "date").alias("_first"), F.min_by("value", F.when(this_year, F.col("date"))).alias("_year"), F.count_if(this_year).alias("_in_year"),
        F.count(upto(20, F.col("r"))).alias("_returns"), F.stddev_pop(upto(20, F.col("r"))).alias("_deviation"), F.avg(upto(20, F.col("value"))).alias("_a20"), F.avg(upto(50, F.col("value"))).alias("_a50"), F.avg(upto(20, F.col("volume"))).alias("_volume"),
    )
    value, n = F.col("latest_value"), F.col("observations")
    return wide.select(
        "index_code", "observations", "latest_date", "latest_value", "previous_value", (value - F.col("previous_value")).alias("latest_daily_change"), change(value, F.col("previous_value")).alias("latest_daily_change_percent"),
        *[change(value, F.col(f"_{k}")).alias(k) for k in LADDER], change(value, F.col("_first")).alias("maximum_return"), F.when(F.col("_in_year") >= 2, change(value, F.col("_year"))).alias("year_to_date_return"),
        F.when(F.col("_returns") >= 20, F.col("_deviation") * F.sqrt(F.lit(252.0)) * 100).alias("rolling_volatility_20"),
        F.when(n >= 20, change(value, F.col("_a20"))).alias("versus_ma_20_percent"), F.when(n >= 50, change(value, F.col("_a50"))).alias("versus_ma_50_percent"),
        "latest_volume", F.when(n >= 20, F.col("_volume")).alias("average_volume_20"),
    )


def clamp(x: Column) -> Column:
    """x within 0 and 1; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def centred(x: Column, scale: float) -> Column:
    return clamp(0.5 + x / (2 * scale))


def condition(score: Column) -> Column:
    """The condition's name for a score out of 100."""
    return F.when(score.isNull(), "Unavailable").when(score < 30, "Strongly Bearish").when(score < 45, "Bearish").when(score <= 55, "Neutral").when(score <= 70, "Bullish").otherwise("Strongly Bullish")


def _scored(df: DataFrame, factors: dict[str, Column], weights: dict[str, int]) -> DataFrame:
    """Adds points (map), score, label, coverage_percentage, unavailable and explanations; missing factors rescale."""
    points = {k: factors[k] * w for k, w in weights.items()}
    df = df.withColumn("points", F.create_map(*[x for k, p in points.items() for x in (F.lit(k), p)]))
    got = lambda k: F.col("points")[k]
    used = sum((F.when(got(k).isNotNull(), w).otherwise(0) for k, w in weights.items()), F.lit(0))
    raw = sum((F.coalesce(got(k), F.lit(0.0)) for k in weights), F.lit(0.0))
    df = df.withColumns({"available_weight": used, "_raw": raw})
    df = df.withColumn("score", F.when(F.col("available_weight") > 0, F.bround(clamp(F.col("_raw") / F.col("available_weight")) * 100, 1)))
    told = [F.when(got(k).isNull(), f"{k}: unavailable.").otherwise(F.format_string(f"{k}: %.1f of {w} points.", got(k))) for k, w in weights.items()]
    return df.withColumns({
        "label": condition(F.col("score")), "coverage_percentage": F.bround(F.col("available_weight") / sum(weights.values()) * 100, 1), "unavailable": F.filter(F.array(*[F.when(got(k).isNull(), k) for k in weights]), lambda x: x.isNotNull()),
        "explanations": F.when(F.col("available_weight") == 0, F.array(F.lit("Insufficient history is available."))).otherwise(F.array(*told)),
    }).drop("_raw")


def index_health(figures: DataFrame) -> DataFrame:
    """A score out of 100 for each index from its own :func:`metrics` (M1, M2)."""
    c = F.col
    factors = {
        "1-day direction": F.when(c("latest_daily_change") > 0, 1.0).when(c("latest_daily_change") < 0, 0.0).when(c("latest_daily_change").isNotNull(), 0.5),
        "5-trading-day return": centred(c("one_week_return"), 10.0),
        "20-trading-day return": centred(c("one_month_return"), 20.0),
        "Value relative to SMA-20": centred(c("versus_ma_20_percent"), 10.0),
        "Value relative to SMA-50": centred(c("versus_ma_50_percent"), 20.0),
        "Short-term momentum": centred(c("one_week_return") - c("one_month_return") / 4, 5.0),
        "Rolling volatility penalty": clamp(1 - c("rolling_volatility_20") / 50),
        "Volume participation": F.when(c("average_volume_20") > 0, clamp(c("latest_volume") / c("average_volume_20") / 1.5)),
    }
    return _scored(figures, factors, INDEX_WEIGHTS).select("index_code", "score", "label", "points", "explanations", F.col("latest_date").alias("reference_date"), F.col("observations").alias("observation_count"), "available_weight", F.col("unavailable").alias("unavailable_components"), "coverage_percentage")


def health_comparison(health: DataFrame) -> DataFrame:
    """Every known index with score, label and observations; those without health are Unavailable, 0 and 0.0 (M4)."""
    spark = health.sparkSession
    known = spark.createDataFrame([(c,) for c in INDEX_CODES], "index_code string")
    joined = known.join(health.select("index_code", "score", "label", "observation_count", "coverage_percentage"), "index_code", "left")
    return joined.withColumns({"label": F.coalesce("label", F.lit("Unavailable")), "observation_count": F.coalesce("observation_count", F.lit(0)), "coverage_percentage": F.coalesce("coverage_percentage", F.lit(0.0))})


def breadth(changes: DataFrame, universe: DataFrame | None = None, by_date: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Advancing, declining and unchanged counts, their ratio and shares, and the volume.

    Rows with a null in symbol, date, change or volume drop; then only the latest date is kept, before the universe
    (symbols) restricts it; ``by_date`` keeps every date. The ratio is infinite if none declines but some advance, null
    if neither. Negative volumes count as 0. Without a row there is one of zeros and nulls (none with ``by_date``).
    With further keys ``by`` each of their values has its own latest date and row; none without a row.
    """
    rows = changes.select(*by, "symbol", "date", finite(F.col("change").cast("double")).alias("change"), finite(F.col("volume").cast("double")).alias("volume")).na.drop(subset=["symbol", "date", "change", "volume"])
    if by and not by_date:
        last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.max("date").alias("_latest"))
        same = F.col("date") == F.col("_latest")
        for k in by:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(last, same, "left_semi")
    elif not by_date:
        rows = rows.join(F.broadcast(rows.agg(F.max("date").alias("_latest"))), F.col("date") == F.col("_latest")).drop("_latest")  # one row
    if universe is not None:
        rows = rows.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    up, down = F.count_if(F.col("change") > 0), F.count_if(F.col("change") < 0)
    sums = [F.count("*").alias("universe_size"), up.alias("advancing"), down.alias("declining"), F.count_if(F.col("change") == 0).alias("unchanged"), F.sum(F.greatest("volume", F.lit(0.0))).alias("total_volume")]
    out = rows.groupBy(*by, "date").agg(*sums).withColumnRenamed("date", "reference_date") if by_date or by else rows.agg(F.max("date").alias("reference_date"), *sums)
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("universe_size"))
    ratio = F.when(F.col("declining") > 0, F.col("advancing") / F.col("declining")).when(F.col("advancing") > 0, F.lit(float("inf")))
    return out.withColumns({"advance_decline_ratio": ratio, "advancing_percent": share("advancing"), "declining_percent": share("declining"), "unchanged_percent": share("unchanged")})


def market_health(figures: DataFrame, market: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A score from all indices' :func:`metrics` and each row of :func:`breadth`, after its keys ``by`` (M3)."""
    trend = lambda code: clamp(0.5 + F.max(F.when(F.col("index_code") == code, F.col("one_month_return"))) / 20)
    above = F.when(F.col("versus_ma_20_percent").isNotNull(), F.when(F.col("versus_ma_20_percent") > 0, 1.0).otherwise(0.0))
    one = figures.agg(
        *[trend(c).alias(c) for c in INDEX_CODES], F.avg(F.when(F.col("average_volume_20") != 0, F.col("latest_volume") / F.col("average_volume_20"))).alias("_volume"), F.avg(above).alias("_above"), F.avg("rolling_volatility_20").alias("_deviation"),
    )
    both = market.join(F.broadcast(one))  # one row
    low = lambda c, k: F.when(F.col(c).isNotNull(), F.least(F.lit(1.0), F.col(c) / k))
    factors = {
        "KSE100 trend": F.col("KSE100"), "KSE30 trend": F.col("KSE30"), "KMI30 trend": F.col("KMI30"), "All Share trend": F.col("ALLSHR"), "Advance/decline ratio": low("advance_decline_ratio", 2.0), "Advancing securities": low("advancing_percent", 70.0),
        "Volume participation": low("_volume", 1.0), "Moving-average position": F.col("_above"), "Volatility penalty": F.when(F.col("_deviation").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("_deviation") / 50)),
    }
    return _scored(both, factors, MARKET_WEIGHTS).select(*by, "score", "label", "points", "explanations", "reference_date", "available_weight", F.col("unavailable").alias("unavailable_components"))


def period_summary(rows: DataFrame, key: str, value: str, volume: str) -> DataFrame:
    """(key, first, latest, high, low, period_return, days, total_volume) of each key's rows (A10)."""
    out = rows.groupBy(key).agg(F.min_by(value, "date").alias("first"), F.max_by(value, "date").alias("latest"), F.max(value).alias("high"), F.min(value).alias("low"), F.count_distinct("date").alias("days"), F.sum(volume).alias("total_volume"))
    return out.withColumn("period_return", (F.try_divide("latest", "first") - 1) * 100)


def join_context(rows: DataFrame, wide: DataFrame, tolerance_days: int = 0) -> DataFrame:
    """Rows with the context of their date (J6) or of the latest date at most ``tolerance_days`` back, as a row.

    Each context row is offered to the dates it may serve, the latest offer to a date wins, and the join is an equi-join
    on date. Dates of ``wide`` are unique. A negative tolerance raises.
    """
    if tolerance_days < 0:
        raise ValueError("a tolerance below 0 days")
    columns = [c for c in wide.columns if c != "date"]
    offers = wide.where("date is not null").select(F.explode(F.sequence("date", F.date_add("date", tolerance_days))).alias("c_date"), F.struct("date", *columns).alias("c"))
    best = offers.groupBy("c_date").agg(F.max_by("c", "c.date").alias("c"))
    joined = rows.join(best, F.col("date") == F.col("c_date"), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.col("c.date").alias("context_date"), *[F.col(f"c.{c}").alias(c) for c in columns])
