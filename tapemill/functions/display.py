"""Display forms of values as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapemill.functions.text import iso_micros

MISSING = "—"
#: Names that differ from their parts in title case.
ENUM_LABELS = {
    "non_compliant": "Non-Compliant",
    "never_seen_in_market_history": "No Local Trading History",
    "listed_recently_traded": "Listed · Recently Traded",
    "listed_not_recently_traded": "Listed · Not Recently Traded",
    "gem_equity": "GEM Equity",
    "etf": "ETF",
    "non_compliant_segment": "Non-Compliant Segment",
    "gem": "GEM",
    "up_to_date": "Up to Date",
}
#: The badge colours of states.
BADGES = {
    "green": ("listed", "listed_recently_traded", "recently_traded"),
    "blue": ("newly_listed",),
    "yellow": ("listed_not_recently_traded", "not_recently_traded"),
    "gray": ("never_seen_in_market_history", "historical", "historical_only", "unknown"),
    "orange": ("suspended", "non_compliant"),
    "red": ("officially_delisted", "delisted"),
}
#: Texts that mean a missing value.
MISSING_TEXTS = ("", "nan", "nat", "none", "null")


def is_missing(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*MISSING_TEXTS), F.lit(True))


def finite_or_null(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def shown(c: Column, fallback: str = MISSING) -> Column:
    return F.when(is_missing(c), fallback).otherwise(F.trim(c.cast("string")))


def humanized(c: Column) -> Column:
    """A known name's label, else its parts in title case."""
    key = F.lower(F.trim(c))
    words = F.initcap(F.trim(F.regexp_replace(key, "[_-]+", " ")))
    label = reduce(lambda acc, kv: F.when(key == kv[0], kv[1]).otherwise(acc), ENUM_LABELS.items(), words)
    return F.when(is_missing(c), MISSING).otherwise(label)


def badge(c: Column) -> Column:
    return reduce(lambda acc, kv: F.when(F.lower(F.trim(c)).isin(*kv[1]), kv[0]).otherwise(acc), BADGES.items(), F.lit("gray"))


#: Column labels that differ from their parts in title case.
COLUMN_LABELS = {"ldcp": "LDCP", "date": "Trading Date", "change_percent": "Change %"}


def column_label(name: str) -> str:
    return COLUMN_LABELS.get(name, name.replace("_", " ").title())


def labelled(df: DataFrame) -> DataFrame:
    """All columns under their labels."""
    return df.select(*[F.col(f"`{c}`").alias(column_label(c)) for c in df.columns])


def _or_missing(x: Column, text: Column) -> Column:
    return F.when(x.isNull(), MISSING).otherwise(text)


def integer(c: Column) -> Column:
    x = finite_or_null(c)
    return _or_missing(x, F.format_string("%,d", F.bround(x, 0).cast("long")))


def decimal(c: Column, precision: int = 2, sign: bool = False) -> Column:
    """Thousands separated; rounded half to even on the decimal text of the value."""
    if precision < 0:
        raise ValueError("precision below 0")
    x = finite_or_null(c)
    text = F.format_string(f"%,.{precision}f", F.bround(x, precision))
    return _or_missing(x, F.concat(F.when((x > 0) & F.lit(sign), "+").otherwise(""), text))


def price(c: Column, currency: str = "PKR") -> Column:
    return _or_missing(finite_or_null(c), F.concat(F.lit(f"{currency} "), decimal(c)))


def percentage(c: Column, sign: bool = True) -> Column:
    return _or_missing(finite_or_null(c), F.concat(decimal(c, 2, sign), F.lit("%")))


def directional(c: Column) -> Column:
    x = finite_or_null(c)
    return _or_missing(x, F.concat(F.when(x > 0, "▲ ").when(x < 0, "▼ ").otherwise("● "), percentage(c)))


def volume(c: Column) -> Column:
    """Abbreviated from a thousand on."""
    x = finite_or_null(c)
    out = integer(c)
    for unit, suffix in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.abs(x) >= unit, F.format_string(f"%.1f{suffix}", F.bround(x / unit, 1))).otherwise(out)
    return _or_missing(x, out)


def day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd MMM yyyy"), F.lit(MISSING))


ZONE = "Asia/Karachi"


def instant(c: Column) -> Column:
    """A zoneless time, taken as local, with the zone's short name."""
    return F.coalesce(F.date_format(c, "dd MMM yyyy, h:mm a 'PKT'"), F.lit(MISSING))


def instant_text(c: Column) -> Column:
    """An ISO text: one with an offset is converted to the zone, one without is local; others are missing."""
    t = F.trim(c)
    micros = F.when(t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), iso_micros(t))
    there = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.timestamp_add("SECOND", F.floor(micros / 1_000_000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return instant(F.coalesce(there, F.when(micros.isNull(), t.try_cast("timestamp_ntz"))))


def source(c: Column) -> Column:
    """Parts between semicolons in human form, addresses as they are."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(is_missing(c), MISSING).otherwise(F.array_join(F.transform(parts, lambda p: F.when(p.contains("://"), p).otherwise(humanized(p))), "; "))


def security(symbol: Column, name: Column) -> Column:
    s, n = shown(symbol, ""), shown(name, "")
    return F.when((s != "") & (n != ""), F.concat(n, F.lit(" ("), s, F.lit(")"))).when(n != "", n).when(s != "", s).otherwise(MISSING)


def trend(above_20: Column, above_50: Column) -> Column:
    side = lambda x, n: F.when(x > 0, f"Above SMA-{n}").when(x <= 0, f"Below SMA-{n}")
    return F.concat_ws(" · ", side(above_20, 20), side(above_50, 50))


def company_table(rows: DataFrame, *more: str) -> DataFrame:
    """A company summary as it is shown, after the columns ``more``: readable states, dates and numbers as such."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        *more, shown(has("symbol")).alias("Symbol"), shown(has("company_name")).alias("Company Name"), humanized(has("security_type")).alias("Security Type"), shown(has("sector")).alias("Sector"), humanized(has("official_status")).alias("Official Status"),
        humanized(has("activity_status")).alias("Trading Activity"), humanized(has("lifecycle_status")).alias("Lifecycle Status"), has("first_seen_date").try_cast("date").alias("First Seen"), has("last_seen_date").try_cast("date").alias("Last Seen"),
        has("trading_days").try_cast("bigint").alias("Trading Days"), has("latest_close").try_cast("double").alias("Latest Close"),
    )


def model_table(models: DataFrame, *more: str) -> DataFrame:
    """Model records as they are shown, after the columns ``more``."""
    c = F.col
    wanted = F.lower(F.trim(c("needs_retraining").cast("string"))).isin("true", "1")
    return models.select(
        *more, humanized(c("model_scope")).alias("Model scope"), shown(c("symbol"), "Master model").alias("Symbol"), integer(c("model_version")).alias("Version"), humanized(c("model_status")).alias("Model status"), instant(c("last_trained_at")).alias("Last trained"),
        day(c("training_data_start")).alias("Training start"), day(c("training_data_end")).alias("Training end"), integer(c("new_data_days")).alias("New trading days"), F.when(wanted, "Recommended").otherwise("Not needed").alias("Retraining recommendation"),
    )
