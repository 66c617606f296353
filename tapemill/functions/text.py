"""Column helpers for the dirty text and time columns of the domain tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def symbol_key(col: Column | str) -> Column:
    """Key form of a symbol: trimmed, upper case. Null stays null."""
    return F.upper(F.trim(_c(col)))


def reported(col: Column | str) -> Column:
    """Comparable form of an attribute text; null where null or blank (not reported).

    Case and outer blanks do not matter, nor blank or hyphen for underscore.
    """
    text = F.translate(F.lower(F.trim(_c(col))), " -", "__")
    return F.when(text != "", text)


def finite(col: Column | str) -> Column:
    """The value, null where it is null or NaN."""
    return F.when(~F.isnan(_c(col)), _c(col))


def zoneless_micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, whatever the session's time zone."""
    c = _c(col)
    micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + micros


def iso_micros(col: Column | str) -> Column:
    """Microseconds since 1970 of an ISO text with offset; null where it does not parse."""
    return F.unix_micros(F.try_to_timestamp(F.trim(_c(col))))
