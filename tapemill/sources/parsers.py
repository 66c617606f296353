"""Scans of semi-structured payloads: equity HTML, listing HTML and index JSON.

A payload is one row of text. Rows and cells are taken out by regular expressions in the JVM; positions are kept, and
what does not conform comes out as a reject with its reason.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapemill.operators import registry

#: The cells of an equity row, and aliases of listing headers.
EQUITY = ("symbol", "ldcp", "open", "high", "low", "close", "change", "change_percent", "volume")
HEADER_ALIASES = {"name": "company_name", "company": "company_name", "free_float_shares": "free_float", "outstanding_shares": "shares", "clearing": "clearing_type"}
#: The headers that a listing table must have.
LISTING_HEADERS = ("symbol", "company_name", "sector", "clearing_type", "shares", "free_float", "listed_in")
#: The entities that market pages use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _text(cell: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(cell, "<[^>]*>", " ")), r"\s+", " "))


def _cell(cell: Column) -> Column:
    """A cell's data-value if it has one, even empty, else its text."""
    given = r'^<td[^>]*?\bdata-value\s*=\s*"([^"]*)"'
    return F.when(cell.rlike(given), unescaped(F.regexp_extract(cell, given, 1))).otherwise(_text(cell))


def equity_rows(pages: DataFrame) -> DataFrame:
    """(page_id, date, row_number, the nine typed fields, reason) of each equity row of ``pages`` (page_id, date, html).

    ``reason`` is empty for good rows: else the wrong cell count, or the first field that is empty or no number.
    """
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*\bdata-type\s*=\s*\"equity\"[^>]*>(.*?)</tr>"), 1)
    each = pages.select("page_id", "date", F.posexplode(rows).alias("n", "row"))
    cells = each.select("page_id", "date", (F.col("n") + 1).alias("row_number"), F.transform(F.regexp_extract_all("row", F.lit(r"(?is)(<td[^>]*>.*?)</td>"), 1), _cell).alias("c"))
    whole = F.size("c") == len(EQUITY)
    text = {name: F.when(whole, F.translate(F.col("c")[i], ",", "")) for i, name in enumerate(EQUITY)}
    text["change_percent"] = F.regexp_replace(text["change_percent"], "%$", "")
    typed = {"symbol": F.when(whole, F.col("c")[0]), **{k: text[k].try_cast("double") for k in EQUITY[1:-1]}, "volume": text["volume"].try_cast("bigint")}
    reason = F.when(~whole, F.concat(F.lit(f"expected {len(EQUITY)} columns, found "), F.size("c").cast("string")))
    for k in EQUITY:
        reason = reason.when(F.coalesce(F.trim(text[k]), F.lit("")) == "", f"{k} is empty").when(typed[k].isNull(), f"{k} is no number")
    return cells.select("page_id", "date", "row_number", *[v.alias(k) for k, v in typed.items()], reason.otherwise("").alias("reason"), "c").withColumnRenamed("c", "raw_values")


def header_key(c: Column) -> Column:
    """A header in lower case with runs of other characters as one underscore (X3), its aliases resolved."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_|_$", "")
    out = key
    for name, known in HEADER_ALIASES.items():
        out = F.when(key == name, known).otherwise(out)
    return out


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_number, symbol, company_name, sector, shares, free_float, fields, complete) of listing tables.

    Columns go by header, in any order; of the symbol and ``listed_in`` it is the data-search attribute where there is one. Counts lose their
    commas; "-" and "N/A" are null. ``complete`` is false where a row's cells do not match the headers.
    """
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<th[^>]*>(.*?)</th>"), 1), lambda h: header_key(_text(h)))
    rows = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: r.rlike("(?i)<td"))
    each = pages.select("page_id", heads.alias("h"), F.posexplode(rows).alias("n", "row"))
    cells = each.select("page_id", "h", (F.col("n") + 1).alias("row_number"), F.regexp_extract_all("row", F.lit(r"(?is)(<td[^>]*>.*?)</td>"), 1).alias("raw"))
    searched = lambda c: F.regexp_extract(c, r'^<td[^>]*?\bdata-search\s*=\s*"([^"]*)"', 1)
    named = lambda i: F.try_element_at(F.col("h"), i + 1).isin("symbol", "listed_in")
    value = F.transform("raw", lambda c, i: F.when(named(i) & (searched(c) != ""), unescaped(searched(c))).otherwise(_text(c)))
    same = F.size("raw") == F.size("h")
    mapped = cells.withColumn("complete", same).withColumn("fields", F.when(same, F.map_from_arrays("h", value)))
    count = lambda k: F.translate(F.col("fields")[k], ",", "").try_cast("bigint")
    return mapped.select("page_id", "row_number", F.upper(F.trim(F.col("fields")["symbol"])).alias("symbol"), F.col("fields")["company_name"].alias("company_name"), F.col("fields")["sector"].alias("sector"), count("shares").alias("shares"), count("free_float").alias("free_float"), "fields", "complete")


def listing_snapshot(pages: DataFrame, refreshed_at: Column, allow_empty: bool = False) -> DataFrame:
    """The rows of listing pages (page_id, html, board, segment, source) with the columns of a snapshot.

    ``segment`` "dc" lists the non-compliant. ValueError if a page lacks a header, or the reason of non-compliance there, has
    no row unless ``allow_empty``, or a row whose cells do not match the headers or that has no symbol.
    """
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<th[^>]*>(.*?)</th>"), 1), lambda h: header_key(_text(h)))
    needed = F.when(F.col("segment") == "dc", F.array(*map(F.lit, (*LISTING_HEADERS, "non_compliance_reason")))).otherwise(F.array(*map(F.lit, LISTING_HEADERS)))
    rows = listing_rows(pages)
    many = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(~F.col("complete") | (F.coalesce("symbol", F.lit("")) == "")).alias("bad"))
    told = pages.select("page_id", F.array_join(F.array_except(needed, heads), ", ").alias("lacking")).join(many, "page_id", "left")
    faulty = told.where((F.col("lacking") != "") | (F.coalesce("bad", F.lit(0)) > 0) | (F.lit(not allow_empty) & F.col("n").isNull())).limit(1).collect()  # a row per page
    if faulty:
        f = faulty[0]
        raise ValueError(f"listing page {f['page_id']}: " + (f"missing {f['lacking']}" if f["lacking"] else "rows that do not match the headers" if f["bad"] else "no rows"))
    field = lambda k: F.coalesce(F.col("fields")[k], F.lit(""))
    both = rows.join(pages.select("page_id", F.col("board").alias("p_board"), "segment", "source"), "page_id")
    dc = F.col("segment") == "dc"
    return both.select(
        "symbol", "company_name", registry.security_type(F.col("symbol"), F.col("company_name"), F.col("sector"), F.col("p_board")).alias("security_type"), "sector", F.when(F.col("p_board") == "gem", "GEM").otherwise("Main").alias("board"), F.when(dc, "non_compliant_segment").otherwise("normal_counter").alias("listing_segment"),
        field("clearing_type").alias("clearing_type"), field("listed_in").alias("listed_in"), "shares", "free_float", F.lit(True).alias("officially_listed"), F.when(dc, "non_compliant").otherwise("listed").alias("official_status"), field("non_compliance_reason").alias("non_compliance_reason"), "source",
        refreshed_at.alias("listing_refreshed_at"), F.to_date(refreshed_at).alias("snapshot_date"),
    )


def index_points(payloads: DataFrame, zone: str = "Asia/Karachi", codes: Iterable[str] | None = None) -> DataFrame:
    """(index_code, position, timestamp, date, value, volume, open, reason) of payloads (index_code, payload).

    A payload is ``{"status": 1, "data": [[timestamp, value, volume, open], ...]}``; a point must have four numbers,
    the first and third whole and not negative. Booleans and texts are no numbers. Dates are the zone's. Rejects keep their
    position; a payload with another status or without data, or of an index that is none of ``codes``, is one without.
    """
    points = F.from_json("payload", "status int, data array<string>")
    fault = F.when(F.lit(codes is not None) & ~F.col("index_code").isin(list(codes or [])), "unsupported index").when(F.coalesce(points["status"], F.lit(1)) != 1, "status is not 1").when(points["data"].isNull(), "no list of data")
    whole = payloads.where("payload is not null").select("index_code", fault.alias("fault"), points["data"].alias("data"))
    each = whole.where("fault is null").select("index_code", F.posexplode("data").alias("position", "point"))
    faults = whole.where("fault is not null").select("index_code", *[F.lit(None).cast(t).alias(c) for c, t in (("position", "int"), ("timestamp", "bigint"), ("date", "date"), ("value", "double"), ("volume", "bigint"), ("open", "double"))], F.col("fault").alias("reason"))
    number = r"\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*"
    shape = rf"^\s*\[{number},{number},{number},{number}\]\s*$"
    at = lambda i: F.nullif(F.regexp_extract("point", shape, i), F.lit(""))
    whole = lambda x: F.when(x.try_cast("double") == F.floor(x.try_cast("double")), x.try_cast("double").cast("long"))
    typed = each.select("index_code", "position", "point", whole(at(1)).alias("timestamp"), at(2).try_cast("double").alias("value"), whole(at(3)).alias("volume"), at(4).try_cast("double").alias("open"))
    reason = F.when(~F.col("point").rlike(shape), "expected 4 numbers").when(F.col("timestamp").isNull(), "timestamp is not whole").when(F.col("timestamp") < 0, "timestamp is negative").when(F.col("volume").isNull(), "volume is not whole").when(F.col("volume") < 0, "volume is negative").otherwise("")
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("SECOND", "timestamp", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))))
    return typed.select("index_code", "position", "timestamp", local.alias("date"), "value", "volume", "open", reason.alias("reason")).unionByName(faults)
