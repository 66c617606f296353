"""Profiles of every column of every load, from mergeable exact power sums, grouped distincts and violation counts.

Power sums (count, sum, sum of squares) are kept in decimals, so that partial results merge exactly in any order and a
load's others are its loader's total less its own. What breaks a rule is a 0/1 variable, whose power sums are its violation
count. Shifts between loads, of values and of rules alike, are standardised differences of those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapemill.functions.text import finite, symbol_key

#: Numeric columns with the decimal type that holds their values exactly.
NUMERIC = {"ldcp": "decimal(18,4)", "open": "decimal(18,4)", "high": "decimal(18,4)", "low": "decimal(18,4)", "close": "decimal(18,4)", "change": "decimal(18,4)", "change_percent": "decimal(18,4)", "volume": "decimal(18,0)"}
COLUMNS = ("bar_id", "symbol", "feed", "date", *NUMERIC, "ingested_at")
#: A price this many times its row's close, or less than one by that many, is out of scale.
SCALE = 1.5
#: Share of a load's rows, above what is usual for its loader, from which a column looks different.
EXCESS = 0.1
PATTERNS = {"symbol": r"^[A-Z0-9]+(-[A-Z]{3})?$", "feed": r"^[a-z0-9_]+$"}


def price_violations(c: str) -> dict[str, Column]:
    """The rules on ``high`` or ``low`` within a row; where a side is missing the rule is not broken."""
    x, close = finite(c), finite("close")
    bodies = F.greatest(finite("open"), close) if c == "high" else F.least(finite("open"), close)
    ratio = F.abs(F.try_divide(x, close))
    rules = {"missing": x.isNull(), "wrong_side": x < bodies if c == "high" else x > bodies, "off_scale": (ratio > SCALE) | (ratio < 1 / SCALE), "whole": x == F.floor(x)}
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


#: The rules' names, and "broken" for any of them.
RULES = ("missing", "wrong_side", "off_scale", "whole", "broken")
VALUE = "value"


def _sums(column: str, variable: str, n: Column, s1: Column, s2: Column, **more: Column) -> Column:
    """What is told of one variable of a load; the power sums are decimals."""
    told = {"nulls": F.lit(0).cast("long"), "least": F.lit(None).cast("string"), "greatest": F.lit(None).cast("string"), "pattern_violations": F.lit(0).cast("long"), "unsummed": F.lit(0).cast("long")} | more
    return F.struct(F.lit(column).alias("column_name"), F.lit(variable).alias("variable"), n.alias("n"), s1.cast("decimal(38,4)").alias("s1"), s2.cast("decimal(38,8)").alias("s2"), *[c.alias(k) for k, c in told.items()])


def _value_sums(c: str, types: dict[str, str]) -> Column:
    kept = finite(c) if types[c] in ("double", "float") else F.col(c)
    numeric = c in NUMERIC
    x = F.col(c).try_cast(NUMERIC[c]) if numeric else F.lit(None).cast("decimal(18,4)")
    shown = lambda v: F.coalesce(v.try_cast(NUMERIC[c]).cast("string"), v.cast("string")) if numeric else v.cast("string")
    more = {"nulls": F.count_if(kept.isNull()), "least": shown(F.min(kept)), "greatest": shown(F.max(kept))}
    if c in PATTERNS:
        more["pattern_violations"] = F.count_if(kept.isNotNull() & ~F.col(c).rlike(PATTERNS[c]))
    if numeric:
        more["unsummed"] = F.count_if(kept.isNotNull() & x.isNull())
    return _sums(c, VALUE, F.count(x), F.sum(x), F.sum((x * x).cast("decimal(38,8)")), **more)


def _rule_sums(c: str) -> list[Column]:
    rules = price_violations(c)
    broken = F.lit(False)
    for r in rules.values():
        broken |= r
    return [_sums(c, k, F.count("*"), F.count_if(r), F.count_if(r)) for k, r in {**rules, "broken": broken}.items()]


def load_sums(bars: DataFrame, columns: tuple[str, ...] = COLUMNS, ruled: tuple[str, ...] = ("high", "low")) -> DataFrame:
    """(load_id, rows, column_name, variable, n, s1, s2, nulls, least, greatest, pattern_violations, unsummed).

    A row per load and variable: the values of each of ``columns`` and the rules on each of ``ruled``, from one aggregate.
    """
    types = dict(bars.dtypes)
    parts = [_value_sums(c, types) for c in columns] + [r for c in ruled for r in _rule_sums(c)]
    return bars.groupBy("load_id").agg(F.count("*").alias("rows"), F.array(*parts).alias("parts")).select("load_id", "rows", F.inline("parts"))


def compared(sums: DataFrame, loads: DataFrame) -> DataFrame:
    """:func:`load_sums` with loader, mean, deviation, and standardised differences to the loader's loads.

    ``standardised_difference``: to the merged sums of the loader's other loads. ``usual_difference``: to the usual load,
    of median mean and median variance over the loader's loads, which odd loads do not move; it is infinite where nothing
    varies in either. ``excess``: the mean less the usual one. Null for text and a loader's only load where there is nothing
    to compare. Loads without a row in ``loads`` count as one loader's. Windows run over loads, not over bars.
    """
    told = loads.select(F.col("load_id").alias("l_load"), "loader").dropDuplicates(["l_load"])
    rows = sums.join(told, F.col("load_id").eqNullSafe(F.col("l_load")), "left").drop("l_load")
    of_loader = Window.partitionBy("loader", "column_name", "variable")
    rows = rows.withColumns({f"o_{k}": F.sum(k).over(of_loader) - F.coalesce(F.col(k), F.lit(0)) for k in ("n", "s1", "s2")})
    mean = lambda p: F.try_divide(F.col(f"{p}s1").cast("double"), F.col(f"{p}n"))
    about = lambda p: F.greatest(F.lit(0.0), F.col(f"{p}s2").cast("double") - F.try_divide(F.col(f"{p}s1").cast("double") ** 2, F.col(f"{p}n")))
    sample = lambda p: F.when(F.col(f"{p}n") > 1, F.try_divide(about(p), F.col(f"{p}n") - 1))
    rows = rows.withColumns({"mean": mean(""), "deviation": F.sqrt(sample("")), "others": mean("o_"), "pooled": F.sqrt((sample("") + sample("o_")) / 2), "variance": F.try_divide(about(""), F.col("n"))})
    rows = rows.withColumns({"u_mean": F.median("mean").over(of_loader), "u_variance": F.median("variance").over(of_loader)})
    excess, size = F.col("mean") - F.col("u_mean"), F.sqrt((F.col("variance") + F.col("u_variance")) / 2)
    usual = F.when(size > 0, excess / size).when(excess > 0, F.lit(float("inf"))).when(excess < 0, F.lit(float("-inf"))).when(excess == 0, 0.0)
    return rows.withColumns({"standardised_difference": F.try_divide(F.col("mean") - F.col("others"), F.col("pooled")), "usual_difference": usual, "excess": excess})


def shifted_prices(bars: DataFrame, loads: DataFrame, excess: float = EXCESS) -> DataFrame:
    """(load_id, column_name, excess) where ``high`` or ``low`` breaks a rule in more of the load's rows than usual.

    The rules' standardised differences to the loader's usual load decide: a 0/1 variable deviates by a half at most, so that
    a rate ``excess`` above the usual one differs by twice that at least. Of those, exactly the ones come out whose rate, of
    any rule or of breaking any, is ``excess`` or more above.
    """
    shifts = compared(load_sums(bars, columns=()), loads).where(F.col("usual_difference") >= 2 * excess - 1e-9)
    return shifts.where(F.col("excess") >= excess - 1e-12).groupBy("load_id", "column_name").agg(F.max("excess").alias("excess"))


def duplicate_counts(bars: DataFrame) -> DataFrame:
    """(load_id, duplicates): a load's rows less its distinct (series, date), by grouped distincts (nulls are values)."""
    keys = bars.select("load_id", symbol_key("symbol").alias("symbol"), "feed", "date").groupBy("load_id", "symbol", "feed", "date").agg(F.count("*").alias("copies"))
    return keys.groupBy("load_id").agg((F.sum("copies") - F.count("*")).alias("duplicates"))


def misstated_duplicates(bars: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, duplicate_count stated, duplicates) of loads whose statement is wrong; null is wrong, no rows are 0."""
    stated = loads.select(F.col("load_id").alias("l_load"), "duplicate_count")
    both = stated.join(duplicate_counts(bars), F.col("load_id").eqNullSafe(F.col("l_load")), "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
    return both.where(~F.col("duplicate_count").eqNullSafe(F.col("duplicates"))).select(F.col("l_load").alias("load_id"), "duplicate_count", "duplicates")


def load_findings(bars: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, column_name) of what :func:`shifted_prices` and :func:`misstated_duplicates` find."""
    prices = shifted_prices(bars, loads).select("load_id", "column_name")
    return prices.unionByName(misstated_duplicates(bars, loads).select("load_id", F.lit("duplicate_count").alias("column_name")))


def distinct_counts(bars: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(d_load, d_column, distinct_values): columns of one type are read and grouped together, by load, column and value.

    So what is shuffled is narrow, in its own type, and each value of a load once per task at most. NaN is null, the two
    zeros are one value.
    """
    by_type: dict[str, list[str]] = {}
    types = dict(bars.dtypes)
    for c in columns:
        by_type.setdefault(types[c], []).append(c)
    out = None
    for kind, names in by_type.items():
        value = lambda c, kind=kind: finite(c) + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(c)
        each = F.inline(F.array(*[F.struct(F.lit(i).alias("number"), value(c).alias("value")) for i, c in enumerate(names)]))
        values = bars.select(F.col("load_id").alias("d_load"), each).where("value is not null").groupBy("d_load", "number", "value").agg(F.lit(1).alias("one"))
        label = F.element_at(F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(i), F.lit(c))]), F.col("number"))
        part = values.groupBy("d_load", "number").agg(F.count("*").alias("distinct_values")).select("d_load", label.alias("d_column"), "distinct_values")
        out = part if out is None else out.unionByName(part)
    return out


def column_profile(bars: DataFrame, loads: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row per load and column: rows, nulls, distinct values, range as text, pattern violations, rows that break the rules on
    the column, mean, deviation and the standardised differences to the loader's other loads and to its usual load.

    Ranges of numbers are in the column's decimal, those of texts are lexical. A value too large for the decimal counts in
    ``unsummed`` and not in the sums. The differences are null for text, for a loader's only load and where nothing varies.
    NaN is null. Distinct counts come from one grouping by (load, column, value) for each type, pre-aggregated before the shuffle.
    """
    both = compared(load_sums(bars, columns, tuple(c for c in ("high", "low") if c in columns)), loads)
    broken = F.max(F.when(F.col("variable") == "broken", F.col("s1").cast("long"))).over(Window.partitionBy("load_id", "column_name"))
    values = both.withColumn("rule_violations", F.coalesce(broken, F.lit(0))).where(F.col("variable") == VALUE)
    distinct = distinct_counts(bars, columns)
    out = values.join(distinct, F.col("load_id").eqNullSafe(F.col("d_load")) & (F.col("column_name") == F.col("d_column")), "left")
    return out.select("load_id", "column_name", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_rate"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "least", "greatest", "pattern_violations", "rule_violations", "unsummed", "mean", "deviation", "standardised_difference", "usual_difference")
