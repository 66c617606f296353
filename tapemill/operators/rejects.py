"""Strict load of delimited lines, and the reasons of those that do not load.

Lines are parsed with column expressions that run in linear time whatever the line (no nested repetition that a
regular-expression engine would recurse into), first strictly: only conforming rows load. The raw offsets less the
loaded ones, by anti-join, are what failed, and only those are diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ten fields of a market line, in order.
FIELDS = ("symbol", "date", "ldcp", "open", "high", "low", "close", "change", "change_percent", "volume")
_NUMBERS = FIELDS[2:9]
#: Stand-ins inside the parser for a quoted piece and for a comma within quotes.
_PIECE, _COMMA = "﷐", "﷑"
_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def _line(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r?\n?\z", "")


def _shape(line: Column) -> Column:
    """The line with every quoted piece as one character; doubled quotes give two adjacent pieces."""
    return F.regexp_replace(F.translate(line, _PIECE, "x"), '"[^"]*"', _PIECE)


def _broken(shape: Column) -> Column:
    return shape.contains('"') | shape.rlike(f"[^,{_PIECE}]{_PIECE}|{_PIECE}[^,{_PIECE}]")


def _fields(line: Column) -> Column:
    """Unquoted, trimmed fields of a line that is soundly quoted."""
    pieces = F.transform(F.split(F.translate(line, _COMMA, "x"), '"', -1), lambda p, i: F.when(i % 2 == 1, F.translate(p, ",", _COMMA)).otherwise(p))
    unquote = lambda f: F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(F.split(F.array_join(pieces, '"'), ",", -1), lambda f: F.trim(F.translate(unquote(f), _COMMA, ",")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row: a projection would be inlined into each of its many uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _parsed(lines: DataFrame) -> DataFrame:
    """Adds broken, columns and f (the fields, where the line is soundly quoted and has ten)."""
    shaped = _once(_once(lines, line=_line(F.col("raw_text"))), shape=_shape(F.col("line")))
    counted = _once(shaped, broken=_broken(F.col("shape")), columns=F.length(F.regexp_replace("shape", "[^,]", "")) + 1)
    return _once(counted, f=F.when(~F.col("broken") & (F.col("columns") == len(FIELDS)), _fields(F.col("line"))))


def _plain(text: Column, percent: bool = False) -> Column:
    text = F.translate(text, ",", "")
    if percent:
        text = F.regexp_replace(text, "%$", "")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _typed(parsed: DataFrame) -> DataFrame:
    """Adds the ten typed fields, each null where it is invalid."""
    f = F.col("f")
    values = {"symbol": F.when(f[0] != "", f[0]), "date": F.when(f[1].rlike(r"^\d{4}-\d{2}-\d{2}$"), f[1].try_cast("date"))}
    for i, name in enumerate(_NUMBERS, 2):
        values[name] = _plain(f[i], name == "change_percent")
    volume = F.translate(f[9], ",", "")
    values["volume"] = F.when(volume.rlike("^[0-9]+$"), volume.try_cast("bigint"))
    # A field that is absent is no valid one either: f is null for lines with another shape.
    return _once(parsed, **{k: F.when(f.isNotNull(), v) for k, v in values.items()})


def _valid() -> Column:
    ok = F.col("f").isNotNull()
    for c in FIELDS:
        ok &= F.col(c).isNotNull()
    return ok & (F.col("high") >= F.col("low"))


def load_strict(lines: DataFrame) -> DataFrame:
    """The conforming rows only: line_id, source_file, line_no and the ten fields, typed."""
    return _typed(_parsed(lines.select("line_id", "source_file", "line_no", "raw_text"))).where(_valid()).select("line_id", "source_file", "line_no", *FIELDS)


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, source_file, line_no, raw_text, reason) of the lines that the strict load did not take.

    The reason is the first that holds: ``broken_quoting`` (a field with a double quote that is not wholly enclosed,
    inner ones doubled), ``column_count`` (not ten; an empty or null line has one), ``invalid_value``. Commas, quotes
    and line ends within quotes belong to the field; a closing carriage return belongs to the line end. Extra columns
    of the table are ignored. Records are told apart by their offset, file and line, and ``line_id``; nulls are matched as equal.
    """
    raw = lines.select("line_id", "source_file", "line_no", "raw_text")
    offset = ("source_file", "line_no", "line_id")
    loaded = load_strict(lines).select(*[F.col(c).alias(f"l_{c}") for c in offset])
    same = F.lit(True)
    for c in offset:
        same &= F.col(c).eqNullSafe(F.col(f"l_{c}"))
    rest = raw.join(loaded, same, "left_anti")
    reason = F.when(F.col("broken"), "broken_quoting").when(F.col("columns") != len(FIELDS), "column_count").otherwise("invalid_value")
    return _parsed(rest).select("line_id", "source_file", "line_no", "raw_text", reason.alias("reason"))


def rejects_by_file(lines: DataFrame, stated: DataFrame) -> DataFrame:
    """source_file, parsed, valid and rejected row counts from the lines, the stated ones, and whether they agree.

    Files with lines but no statement, and stated files without lines, come out too. A null statement does not agree.
    """
    counts = lines.groupBy("source_file").agg(F.count("*").alias("parsed_rows"))
    bad = rejected(lines).groupBy("source_file").agg(F.count("*").alias("rejected_rows")).withColumnRenamed("source_file", "bad_file")
    told = stated.select(F.col("source_file").alias("told_file"), F.col("rejected_rows").alias("stated_rejected"), F.col("valid_rows").alias("stated_valid"))
    both = counts.join(bad, F.col("source_file").eqNullSafe(F.col("bad_file")), "left").join(told, F.col("source_file").eqNullSafe(F.col("told_file")), "full_outer")
    parsed, no = F.coalesce("parsed_rows", F.lit(0)), F.coalesce("rejected_rows", F.lit(0))
    return both.select(
        F.coalesce("source_file", "told_file").alias("source_file"), parsed.alias("parsed_rows"), (parsed - no).alias("valid_rows"), no.alias("rejected_rows"), "stated_valid", "stated_rejected",
        (F.coalesce(no == F.col("stated_rejected"), F.lit(False)) & F.coalesce(parsed - no == F.col("stated_valid"), F.lit(False))).alias("agrees"),
    )
