"""The security registry: outer merge of listings and history, lifecycle, overrides, filters (A1, A2, A5, J1-J3, J8-J10,
F6-F8, X6-X10, M8)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapemill.operators.dedup import assert_one, keep_last

#: Fixed values.
OFFICIAL_STATUSES = ("listed", "suspended", "non_compliant", "delisted", "historical", "unknown")
SECURITY_TYPES = ("ordinary_equity", "etf", "right", "preference_share", "gem_equity", "other", "unknown")
LISTED_IN_MONTH = r"-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]?$"


def squeezed(c: Column) -> Column:
    """The text trimmed with inner white space collapsed; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def security_type(symbol: Column, name: Column, sector: Column, board: Column) -> Column:
    """The type that listing data imply: right, etf, preference, gem board, trust, else ordinary."""
    told = F.upper(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(sector, F.lit(""))))
    return (
        F.when(told.rlike(r"\bRIGHTS?\b"), "right")
        .when(F.upper(symbol).contains("ETF") | told.rlike(r"\bETF\b") | told.contains("EXCHANGE TRADED FUND"), "etf")
        .when(told.contains("PREF"), "preference_share")
        .when(board == "gem", "gem_equity")
        .when(told.contains("REAL ESTATE INVESTMENT TRUST") | told.rlike(r"\bREIT\b"), "other")
        .otherwise("ordinary_equity")
    )


def history_type(symbol: Column) -> Column:
    """The type of a symbol known from trading only: contracts with a month are other."""
    return F.when(symbol.rlike(LISTED_IN_MONTH), "other").otherwise("unknown")


def lifecycle(status: Column, listed: Column, new: Column, activity: Column) -> Column:
    """Delisted, suspended, non-compliant, new, listed by activity, historical, in this order."""
    return (
        F.when(status == "delisted", "officially_delisted").when(status == "suspended", "suspended").when(status == "non_compliant", "non_compliant").when(new & listed, "newly_listed")
        .when(listed & (activity == "recently_traded"), "listed_recently_traded").when(listed, "listed_not_recently_traded").when(status == "historical", "historical_only").otherwise("unknown")
    )


def days_since(day: Column, reference: Column) -> Column:
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(reference, day)))


def activity(day: Column, reference: Column, window: int) -> Column:
    age = days_since(day, reference)
    return F.when(age.isNull(), "never_seen_in_market_history").when(age <= window, "recently_traded").otherwise("not_recently_traded")


def noted(old: Column, added: Column) -> Column:
    """Both notes, squeezed, joined by "; "; empty ones drop."""
    blank = lambda c: F.when(squeezed(c) != "", squeezed(c))
    return F.concat_ws("; ", blank(old), blank(added))


def history_ranges(bars: DataFrame) -> DataFrame:
    """(symbol, first_seen_date, last_seen_date, trading_days) of symbols with a date (A1).

    By (symbol, date) first, so that a hot symbol's rows meet in no one task.
    """
    days = bars.where("date is not null and trim(symbol) <> ''").groupBy(F.trim("symbol").alias("symbol"), "date").agg(F.lit(1).alias("one"))
    return days.groupBy("symbol").agg(F.min("date").alias("first_seen_date"), F.max("date").alias("last_seen_date"), F.count("*").alias("trading_days"))


def merge(listings: DataFrame, history: DataFrame, reference: date, recent: int = 30, new: int = 30) -> DataFrame:
    """The registry of all listed or traded symbols, before overrides.

    ``listings``: symbol (unique), company_name, security_type, sector, board, listing_segment, officially_listed,
    official_status, source, non_compliance_reason. Symbols known from trading only are historical.
    """
    ref = F.lit(reference)
    both = listings.join(history, "symbol", "full_outer")
    listed = F.coalesce("officially_listed", F.lit(False))
    known = lambda c: F.when(squeezed(F.col(c)) != "", F.lower(squeezed(F.col(c)))).otherwise("unknown")
    out = both.withColumn("officially_listed", listed)
    out = out.withColumns({
        **{c: squeezed(F.col(c)) for c in ("company_name", "sector", "board", "listing_segment")},
        "official_status": F.when(F.col("officially_listed"), known("official_status")).otherwise("historical"),
        "source": F.when(F.col("officially_listed"), squeezed(F.col("source"))).otherwise("master_market_history"),
        "security_type": F.when(F.col("officially_listed"), known("security_type")).otherwise(history_type(F.col("symbol"))),
        "trading_days": F.coalesce("trading_days", F.lit(0)), "days_since_last_seen": days_since(F.col("last_seen_date"), ref), "activity_status": activity(F.col("last_seen_date"), ref, recent),
        "is_new_listing": F.coalesce(days_since(F.col("first_seen_date"), ref) <= new, F.lit(False)) & F.col("officially_listed"),
        **{c: F.lit("") for c in ("previous_symbol", "successor_symbol", "corporate_action_type")}, "notes": squeezed(F.col("non_compliance_reason")),
    }).drop("non_compliance_reason")
    return classified(out)


def classified(registry: DataFrame) -> DataFrame:
    return registry.withColumn("lifecycle_status", lifecycle(F.col("official_status"), F.col("officially_listed"), F.col("is_new_listing"), F.col("activity_status")))


def unknown_overrides(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override symbols that the registry lacks."""
    return overrides.select("symbol").distinct().join(registry.select("symbol"), "symbol", "left_anti")


#: The columns of an override file.
OVERRIDES = ("symbol", "company_name_override", "official_status_override", "previous_symbol", "successor_symbol", "corporate_action_type", "notes")


def normalized_overrides(overrides: DataFrame) -> DataFrame:
    """Exactly the columns of ``OVERRIDES``, squeezed, symbols in upper case, statuses in lower case; lacking ones are blank (M9)."""
    text = {c: squeezed(F.col(c)) if c in overrides.columns else F.lit("") for c in OVERRIDES}
    upper = ("symbol", "previous_symbol", "successor_symbol")
    return overrides.select(*[(F.upper(t) if c in upper else F.lower(t) if c == "official_status_override" else t).alias(c) for c, t in text.items()])


def checked_overrides(overrides: DataFrame) -> DataFrame:
    """:func:`normalized_overrides`; ValueError for a column that is none of theirs, no symbol, a blank or repeated one, or an
    unknown status."""
    unknown = sorted(set(overrides.columns) - set(OVERRIDES))
    if "symbol" not in overrides.columns or unknown:
        raise ValueError(f"overrides: unsupported columns {', '.join(unknown)}" if unknown else "overrides: no symbol column")
    rows = normalized_overrides(overrides)
    status = F.col("official_status_override")
    told = rows.agg(F.count_if(F.col("symbol") == "").alias("blank symbols"), F.count_if((status != "") & ~status.isin(list(OFFICIAL_STATUSES))).alias("unknown statuses")).first()
    bad = [k for k, n in told.asDict().items() if n]
    if bad:
        raise ValueError(f"overrides: {', '.join(bad)}")
    return assert_one(rows, ["symbol"], "overrides")


def override(registry: DataFrame, overrides: DataFrame, check: bool = True) -> DataFrame:
    """Non-blank overrides win, notes and the source are added to, the lifecycle is classified anew.

    Overrides are normalised first. With ``check``, what :func:`checked_overrides` refuses, and symbols that the registry
    lacks, raise ValueError; without, symbols must be unique.
    """
    overrides = checked_overrides(overrides) if check else normalized_overrides(overrides)
    if check:
        lost = [r[0] for r in unknown_overrides(registry, overrides).limit(20).collect()]
        if lost:
            raise ValueError(f"overrides of symbols without listing or history: {sorted(lost)}")
    o = overrides.select([F.col(c).alias(f"o_{c}") for c in overrides.columns])
    both = registry.join(o, F.col("symbol") == F.col("o_symbol"), "left")
    wins = lambda new, old: F.when(F.col(new) != "", F.col(new)).otherwise(F.col(old))
    out = both.withColumns({
        "company_name": wins("o_company_name_override", "company_name"), "official_status": wins("o_official_status_override", "official_status"), **{c: wins(f"o_{c}", c) for c in ("previous_symbol", "successor_symbol", "corporate_action_type")},
        "notes": F.when(F.col("o_symbol").isNotNull(), noted(F.col("notes"), F.col("o_notes"))).otherwise(F.col("notes")), "source": F.when(F.col("o_symbol").isNotNull(), noted(F.col("source"), F.lit("manual_override"))).otherwise(F.col("source")),
    })
    return classified(out.drop(*o.columns))


def counts(registry: DataFrame) -> DataFrame:
    """One row of conditional counts (A5)."""
    c = F.col
    return registry.agg(
        F.count("*").alias("total"), F.count_if("officially_listed").alias("listed"), F.count_if(c("activity_status") == "recently_traded").alias("recently_traded"), F.count_if(c("officially_listed") & (c("activity_status") != "recently_traded")).alias("listed_idle"),
        F.count_if("is_new_listing").alias("new_listings"), F.count_if(c("lifecycle_status") == "historical_only").alias("historical_only"), F.count_if(c("official_status") == "non_compliant").alias("non_compliant"), F.count_if(c("official_status") == "suspended").alias("suspended"),
        F.count_if(c("official_status") == "delisted").alias("delisted"), F.count_if(c("security_type") == "ordinary_equity").alias("ordinary_equity"),
    )


def select_rows(registry: DataFrame, facets: dict[str, list[str]] | None = None, listed_only: bool = False, ordinary_only: bool = False, search: str = "", first_seen: tuple | None = None, last_seen: tuple | None = None, least_days: int | None = None) -> DataFrame:
    """Rows in every facet's list (an empty list filters nothing), with the literal text in symbol or name, any case."""
    out = registry
    for c, allowed in (facets or {}).items():
        if allowed:
            out = out.where(F.col(c).isin(allowed))
    if listed_only:
        out = out.where("officially_listed")
    if ordinary_only:
        out = out.where("security_type = 'ordinary_equity'")
    if search:
        out = out.where(F.lower("symbol").contains(search.lower()) | F.lower("company_name").contains(search.lower()))
    for c, span in (("first_seen_date", first_seen), ("last_seen_date", last_seen)):
        if span:
            out = out.where(F.col(c).between(*span))
    return out if least_days is None else out.where(F.col("trading_days") >= least_days)


def restrict(bars: DataFrame, chosen: DataFrame) -> DataFrame:
    """Bars of the chosen symbols."""
    return bars.join(chosen.select("symbol").distinct(), "symbol", "left_semi")


def universe(registry: DataFrame, types: list[str], least_days: int) -> DataFrame:
    """Distinct trimmed symbols that are listed, recently traded, of a type and with enough days (F8)."""
    rows = registry.where(F.col("officially_listed") & (F.col("activity_status") == "recently_traded") & F.col("security_type").isin(types) & (F.col("trading_days") >= least_days))
    return rows.select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()


def attach(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Features with is_active, official_status, lifecycle_status and security_type of their symbol.

    Repeated registry symbols count once, the last by lifecycle, status and type. Missing ones are inactive and unknown.
    """
    active = F.col("officially_listed") & (F.col("activity_status") == "recently_traded")
    rows = registry.select("symbol", active.alias("is_active"), "official_status", "lifecycle_status", "security_type")
    one = keep_last(rows, ["symbol"], ["lifecycle_status", "official_status", "security_type", "is_active"])
    joined = features.join(one, "symbol", "left")
    return joined.withColumns({"is_active": F.coalesce("is_active", F.lit(False)), **{c: F.coalesce(c, F.lit("unknown")) for c in ("official_status", "lifecycle_status", "security_type")}})


def company_summary(bars: DataFrame, registry: DataFrame, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per symbol, and the further keys ``by``, first and last date, distinct days, latest close (of the last dated row, null kept) and metadata."""
    days = bars.where("date is not null and trim(symbol) <> ''").groupBy(*by, F.trim("symbol").alias("symbol"), "date").agg(F.count("*").alias("n"), F.max(F.struct(tie, "close"))["close"].alias("close"))
    per = days.groupBy(*by, "symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("trading_days"), F.sum("n").alias("rows"), F.max_by("close", "date").alias("latest_close"))
    return per.join(registry.select("symbol", "company_name", "sector", "security_type", "official_status", "lifecycle_status"), "symbol", "left")
