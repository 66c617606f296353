"""File scans (S1-S9, S14) and sinks (K1-K8) of market data.

Files are listed, looked at and read through the file system of their path, never by the driver's own. They are read with
declared schemas; symbols are text and never inferred. Writers stage and rename, and a table may be computed from itself.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable, Iterable
from contextlib import closing, suppress
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapemill.operators import quality
from tapemill.operators.dedup import assert_one, by_priority, keep_last

#: The columns of a daily market file, of a listing snapshot, and those of the latter that must be there.
DAILY = ("symbol", "date", "ldcp", "open", "high", "low", "close", "change", "change_percent", "volume")
SNAPSHOT = ("symbol", "company_name", "security_type", "sector", "board", "listing_segment", "clearing_type", "listed_in", "shares", "free_float", "officially_listed", "official_status", "non_compliance_reason", "source", "listing_refreshed_at", "snapshot_date")
SNAPSHOT_REQUIRED = ("symbol", "company_name", "security_type", "officially_listed", "official_status")
#: The columns of the company registry and of the model registry, with the types that are no texts.
REGISTRY = ("symbol", "company_name", "security_type", "sector", "board", "listing_segment", "clearing_type", "listed_in", "shares", "free_float", "officially_listed", "official_status", "first_seen_date", "last_seen_date", "trading_days", "days_since_last_seen", "activity_status", "lifecycle_status", "is_new_listing", "source", "listing_refreshed_at", "cached_listings_used", "registry_updated_at", "previous_symbol", "successor_symbol", "corporate_action_type", "notes")
REGISTRY_TYPES = {"first_seen_date": "date", "last_seen_date": "date", "officially_listed": "boolean", "is_new_listing": "boolean", "cached_listings_used": "boolean", "trading_days": "bigint", "days_since_last_seen": "bigint", "shares": "double", "free_float": "double"}
MODELS = ("model_id", "model_scope", "symbol", "algorithm", "model_version", "model_status", "training_status", "feature_version", "environment_version", "created_at", "last_trained_at", "training_data_start", "training_data_end", "validation_data_start", "validation_data_end", "test_data_start", "test_data_end", "training_rows", "validation_rows", "test_rows", "dataset_latest_date", "new_data_days", "needs_retraining", "model_path", "scaler_path", "metrics_path", "training_duration_seconds", "random_seed", "notes")
MODEL_TYPES = {"model_version": "bigint", "needs_retraining": "boolean"}
INDEX = ("index_code", "index_name", "date", "timestamp", "value", "volume", "open", "daily_change", "daily_change_percent", "source", "fetched_at")
INDEX_TYPES = {"date": "date", "timestamp": "bigint", "value": "double", "volume": "bigint", "open": "double", "daily_change": "double", "daily_change_percent": "double", "fetched_at": "timestamp_ntz"}
DAILY_TYPES = {"symbol": "string", "date": "date", "volume": "bigint"}
DAILY_NAME = r"^market_(\d{4}-\d{2}-\d{2})\.csv$"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def listed(spark: SparkSession, folder: str | Path, pattern: str) -> list[str]:
    """Paths of the folder's files of that pattern, by name; none if there is no folder."""
    fs, at = _fs(spark, str(folder))
    return sorted(f.getPath().toString() for f in fs.globStatus(at(str(folder), pattern)) or ())


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, at = _fs(spark, str(path))
    return fs.exists(at(str(path)))


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    fs, at = _fs(spark, path)
    java = spark.sparkContext._jvm.java.io
    with closing(java.BufferedReader(java.InputStreamReader(fs.open(at(path)), "UTF-8"))) as lines:
        got = [lines.readLine() for _ in range(n)]
    return [line for line in got if line is not None]


def header_of(spark: SparkSession, path: str | Path, required: Iterable[str] = ()) -> list[str]:
    """The column names of a CSV file; ValueError if it cannot be read, has no row or lacks one of ``required``."""
    try:
        first = _first_lines(spark, str(path), 2)
    except Py4JJavaError as error:
        raise ValueError(f"unreadable: {error.java_exception.getMessage()}") from error
    if len(first) < 2 or not first[0].strip():
        raise ValueError("empty")
    header = [c.strip() for c in next(csv.reader([first[0].removeprefix("\ufeff")]))]
    lacking = [c for c in required if c not in header]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return header


def read_csv(spark: SparkSession, paths: str | list[str], header: Iterable[str], multi_line: bool = False) -> DataFrame:
    """CSV with the given header, every field as text; NA, nan and null are ordinary texts, empty fields are null.

    ``multi_line``: quoted fields may hold line ends; then a file is one task's, else large ones are split.
    """
    schema = ", ".join(f"`{c}` string" for c in header)
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(paths)


def projected(df: DataFrame, columns: Iterable[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly ``columns``, in order; those that ``df`` lacks are null, with their type of ``types`` or text."""
    kinds = types or {}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns])


def empty(spark: SparkSession, columns: Iterable[str], types: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns))


def typed_daily(rows: DataFrame) -> DataFrame:
    """Daily text columns with their types; what does not convert is null."""
    return rows.withColumns({c: F.trim(c).try_cast(DAILY_TYPES.get(c, "double")) for c in DAILY if c in rows.columns})


@dataclass(frozen=True)
class Rejected:
    path: str
    reason: str


#: What a row of a daily folder has besides: where it stands.
PLACE = {"source_path": "string", "source_modified": "timestamp", "source_order": "int", "source_block": "bigint", "source_row": "bigint"}


def _placed(rows: DataFrame) -> DataFrame:
    """Adds where each row stands: file, part of the file, place within the part. The latter two order a file's rows."""
    return rows.select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("source_modified"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("source_block"), F.monotonically_increasing_id().alias("source_row"))


def read_daily_folder(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, list[Rejected]]:
    """All rows of the folder's ``market_*.csv`` with the columns of ``PLACE``, and whole-file rejects.

    A file is rejected if it is unreadable, empty, lacks a column or has a date that is none. Extra columns are dropped.
    Headers are looked at on the driver, two lines per file; rows are not.
    """
    rejects, by_header, order = [], {}, []
    for i, path in enumerate(listed(spark, folder, "market_*.csv")):
        order.append((path.rsplit("/", 1)[1], i))
        try:
            by_header.setdefault(tuple(header_of(spark, path, DAILY)), []).append(path)
        except ValueError as error:
            rejects.append(Rejected(path, str(error)))
    rows = None
    for header, paths in by_header.items():
        part = typed_daily(_placed(read_csv(spark, paths, header))).select(*DAILY, "source_path", "source_modified", "source_block", "source_row", "_name")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return empty(spark, (*DAILY, *PLACE), {c: "double" for c in DAILY} | DAILY_TYPES | PLACE), rejects
    bad = [r[0] for r in rows.where("date is null").select("source_path").distinct().collect()]  # names of files
    rejects += [Rejected(p, "invalid dates") for p in sorted(bad)]
    if bad:
        rows = rows.where(~F.col("source_path").isin(bad))
    # One short row per file, of those that the driver has listed; Spark sees its size and joins accordingly.
    number = spark.createDataFrame(order, "_name string, source_order int")
    return rows.join(number, "_name").select(*DAILY, *PLACE), rejects


def master_dataset(rows: DataFrame) -> DataFrame:
    """One row per (symbol, date): of the newest file, then the last file by name, then the later row in it."""
    return keep_last(rows, ["symbol", "date"], ["source_modified", "source_order", "source_block", "source_row"]).select(*DAILY)


def combined(spark: SparkSession, paths: Iterable[str | Path]) -> tuple[DataFrame | None, list[Rejected]]:
    """All rows of the files that can be read, with all their columns; dates that are none are null, nothing is deduplicated (S3).

    Columns that a file lacks are null. None if no file can be read.
    """
    rejects, by_header = [], {}
    for path in map(str, paths):
        try:
            by_header.setdefault(tuple(header_of(spark, path)), []).append(path)
        except ValueError as error:
            rejects.append(Rejected(path, str(error)))
    rows = None
    for header, files in by_header.items():
        part = typed_daily(read_csv(spark, files, header))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows, rejects


def available_dates(folder: str | Path, spark: SparkSession | None = None) -> list[date]:
    """Dates with a daily file that is complete and holds that date only (S14). Files are read by Spark, all at once."""
    spark = spark or SparkSession.active()
    by_header = {}
    for path in listed(spark, folder, "market_*.csv"):
        with suppress(ValueError):
            by_header.setdefault(tuple(header_of(spark, path, DAILY)), []).append(path)
    found = []
    for header, paths in by_header.items():
        day = F.regexp_extract("_name", DAILY_NAME, 1).try_cast("date")
        rows = read_csv(spark, paths, header).select(F.trim("date").try_cast("date").alias("date"), F.col("_metadata.file_name").alias("_name"))
        whole = rows.groupBy("_name").agg(F.bool_and(F.coalesce(F.col("date") == day, F.lit(False))).alias("whole"))
        found += [r["day"] for r in whole.where("whole").select(day.alias("day")).collect()]  # a row per file
    return sorted(found)


def read_with_fallback(spark: SparkSession, master: str, folder: str) -> tuple[DataFrame, str, str]:
    """The master if it is readable and complete, else the raw files; with the source's name and a message."""
    try:
        rows = spark.read.parquet(master)
        lacking = [c for c in DAILY if c not in rows.columns]
        if not lacking and not rows.isEmpty():
            return rows.select(*DAILY), "master", ""
        reason = f"missing columns: {', '.join(lacking)}" if lacking else "empty"
    except Exception as error:  # noqa: BLE001  whatever makes it unreadable
        reason = str(error).splitlines()[0]
    rows, rejects = read_daily_folder(spark, folder)
    return rows.select(*DAILY), "raw", f"master not used ({reason}); {len(rejects)} file(s) rejected"


def read_snapshot(spark: SparkSession, path: str | Path, required: Iterable[str] = SNAPSHOT_REQUIRED) -> DataFrame:
    """A listing snapshot with the symbol in key form; raises ValueError if it is empty, lacks a column, or has blank or
    repeated symbols (S5)."""
    header = header_of(spark, path, required)
    rows = read_csv(spark, str(path), header, multi_line=True).withColumn("symbol", F.upper(F.trim("symbol")))
    told = quality.dataset_summary(rows.withColumn("date", F.current_date()), tuple(required)).first()
    if not told["rows"] or told["blank_symbols"]:
        raise ValueError("snapshot is empty or has blank symbols")
    return projected(assert_one(rows, ["symbol"], "snapshot"), SNAPSHOT)


def newest_snapshot(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, str]:
    """The current snapshot, else the newest dated one that validates."""
    for path in [f"{folder}/listings.csv", *reversed(listed(spark, folder, "listings_*.csv"))]:
        with suppress(ValueError):
            return read_snapshot(spark, path), path
    raise ValueError("no valid snapshot")


STRICT_TRUE, STRICT_FALSE = ("true", "1"), ("false", "0")


def strict_boolean(c: Column) -> Column:
    """true, 1, false, 0 in any case, trimmed; anything else raises when the row is read."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*STRICT_TRUE), True).when(t.isin(*STRICT_FALSE), False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


def lenient_boolean(c: Column, strip: bool = True, also: tuple[str, ...] = ()) -> Column:
    """true or 1 (or one of ``also``) in any case; anything else is false. ``strip``: blanks around do not matter."""
    t = F.lower(c.cast("string"))
    return F.coalesce((F.trim(t) if strip else t).isin("true", "1", *also), F.lit(False))


def _checked(rows: DataFrame, types: dict[str, str], what: str) -> DataFrame:
    """Text columns with their types; raises ValueError if a boolean is none. Other values that do not convert are null."""
    flags = [c for c, t in types.items() if t == "boolean"]
    known = lambda c: F.lower(F.trim(c)).isin(*STRICT_TRUE, *STRICT_FALSE)
    told = rows.agg(*[F.count_if(~F.coalesce(known(c), F.lit(False))).alias(c) for c in flags]).first()
    bad = [c for c in flags if told[c]]
    if bad:
        raise ValueError(f"{what}: invalid values in {', '.join(bad)}")
    return rows.withColumns({c: strict_boolean(F.col(c)) if t == "boolean" else F.trim(c).try_cast(t) for c, t in types.items()})


def read_company_registry(spark: SparkSession, path: str | Path) -> tuple[DataFrame, list[str]]:
    """The company registry with its types, and errors, which are told and not raised.

    Dates and numbers that are none are null, booleans must be. An absent file is an empty registry, a faulty one too.
    """
    nothing = empty(spark, REGISTRY, REGISTRY_TYPES)
    if not exists(spark, path):
        return nothing, []
    try:
        rows = read_csv(spark, str(path), header_of(spark, path, REGISTRY), multi_line=True)
        return _checked(rows.withColumn("symbol", F.trim("symbol")), REGISTRY_TYPES, "registry").select(*REGISTRY), []
    except ValueError as error:
        return nothing, [f"{path}: {error}"]


def read_model_registry(spark: SparkSession, path: str | Path, scopes: Iterable[str] = ("symbol", "master"), statuses: Iterable[str] = ("not_trained", "training", "trained", "failed", "archived")) -> DataFrame:
    """The model registry with its types; absent is empty. ValueError for a lacking column, an unknown scope or status, a
    repeated id, a version that is no number or a flag that is none (S8)."""
    if not exists(spark, path):
        return empty(spark, MODELS, MODEL_TYPES)
    try:
        header = header_of(spark, path, MODELS)
    except ValueError as error:
        if str(error) == "empty":
            return empty(spark, MODELS, MODEL_TYPES)
        raise
    rows = read_csv(spark, str(path), header, multi_line=True)
    told = rows.agg(
        F.count_if(~F.col("model_scope").isin(*scopes)).alias("scopes"), F.count_if(~F.col("model_status").isin(*statuses)).alias("statuses"), F.count_if(F.trim("model_version").try_cast("double").isNull()).alias("model versions"),
    ).first()
    bad = [k for k, n in told.asDict().items() if n]
    if bad:
        raise ValueError(f"model registry: invalid {', '.join(bad)}")
    whole = rows.withColumn("model_version", F.trim("model_version").try_cast("double").cast("bigint").cast("string"))
    return _checked(assert_one(whole, ["model_id"], "model registry"), MODEL_TYPES, "model registry").select(*MODELS)


def read_index(spark: SparkSession, path: str | Path) -> DataFrame:
    """A stored index series with its types; absent is empty, lacking columns are null."""
    if not exists(spark, path):
        return empty(spark, INDEX, INDEX_TYPES)
    try:
        rows = read_csv(spark, str(path), header_of(spark, path))
    except ValueError:
        return empty(spark, INDEX, INDEX_TYPES)
    texts = projected(rows, INDEX)
    return texts.withColumns({c: F.trim(c).try_cast(t) for c, t in INDEX_TYPES.items()})


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), **options: str) -> None:
    """Write beside ``path`` and swap it in by two renames; ``df`` may read ``path`` itself (K1).

    A reader sees the old table or the new one, or, for the instant between the renames, none. If the second fails the old
    table is put back.
    """
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).partitionBy(*partition_by).save(staged)
    fs, at = _fs(df.sparkSession, path)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"could not put {path} in place")
    fs.delete(at(old), True)


def safe_component(text: str) -> str:
    """A name that is safe within a path (X11); an empty one raises."""
    out = re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("._")
    if not out:
        raise ValueError(f"no safe name in {text!r}")
    return out


def write_by_symbol(df: DataFrame, path: str) -> None:
    """One partition per symbol, under a safe name (K4); rows are gathered by symbol before, so files are few.

    ValueError if a symbol has no safe name or two symbols have the same; then nothing is written.
    """
    safe = F.regexp_replace(F.regexp_replace("symbol", "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    named = df.withColumn("part", safe)
    names = named.groupBy("part").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("some"))
    clash = names.where("n > 1 or part = '' or part is null").limit(1).collect()
    if clash:
        raise ValueError(f"no safe name of its own for {clash[0]['some']!r}")
    replace_table(named.repartition("part"), path, partition_by=["part"])


def upsert_index(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The stored series with the new rows, the last fetched of each (index_code, date); null dates drop."""
    fs, at = _fs(spark, path)
    both = spark.read.parquet(path).unionByName(rows, allowMissingColumns=True) if fs.exists(at(path)) else rows
    replace_table(keep_last(both.where("date is not null"), ["index_code", "date"], ["fetched_at", "timestamp"]), path)
    return spark.read.parquet(path)


def combined_index_master(spark: SparkSession, path: str, series: Iterable[DataFrame]) -> DataFrame:
    """All series in one table, the last fetched row of each (date, index_code), in that order."""
    both = None
    for s in series:
        part = projected(s, INDEX, INDEX_TYPES)
        both = part if both is None else both.unionByName(part)
    both = empty(spark, INDEX, INDEX_TYPES) if both is None else both
    last = keep_last(both.where("date is not null"), ["index_code", "date"], ["fetched_at", "timestamp"])
    replace_table(last.orderBy("date", "index_code"), path)
    return spark.read.parquet(path)


def refresh_indices(spark: SparkSession, folder: str, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """Upserts every series that its source gives and rebuilds the master; (master, what went wrong by code).

    A source that fails leaves its stored series as it is, and the others are refreshed all the same.
    """
    failed, stored = {}, []
    for code, source in sorted(sources.items()):
        path = f"{folder}/{safe_component(code)}"
        try:
            stored.append(upsert_index(spark, path, source()))
        except Exception as error:  # noqa: BLE001  one series' failure is no other's
            failed[code] = str(error).splitlines()[0]
            if exists(spark, path):
                stored.append(spark.read.parquet(path))
    return combined_index_master(spark, f"{folder}/master", stored), failed


def write_ingest(rows: DataFrame, valid_path: str, rejects_path: str) -> tuple[int, int]:
    """Valid rows by symbol, and rejects with reasons only if there are any (K8); (valid, rejected) counts.

    The rows are classified and written once, apart by whether they are valid; both tables come from what was written.
    """
    spark = rows.sparkSession
    staged = f"{valid_path}.classified-{uuid.uuid4().hex}"
    fs, at = _fs(spark, staged)
    try:
        rows.withColumn("reason", quality.validation_reasons(rows)).withColumn("_sound", (F.col("reason") == "").cast("int")).write.partitionBy("_sound").parquet(staged)
        if not fs.globStatus(at(f"{staged}/_sound=*")):  # no rows at all
            replace_table(rows.limit(0), valid_path)
            return 0, 0
        told = spark.read.parquet(staged)
        counts = {r["_sound"]: r["count"] for r in told.groupBy("_sound").count().collect()}
        replace_table(told.where("_sound = 1").drop("_sound", "reason").orderBy("symbol"), valid_path)
        if counts.get(0):
            replace_table(told.where("_sound = 0").drop("_sound"), rejects_path)
        return counts.get(1, 0), counts.get(0, 0)
    finally:
        fs.delete(at(staged), True)


def export_csv(df: DataFrame, path: str) -> None:
    """All rows as CSV parts with headers and ISO dates (K7)."""
    replace_table(df, path, "csv", header="true", dateFormat="yyyy-MM-dd")


def refresh_listings(spark: SparkSession, folder: str | Path, pages: Callable[[], DataFrame], refreshed_at: Column) -> tuple[DataFrame, str, bool]:
    """Fetched listing pages as one snapshot, kept in ``folder``; (rows, message, whether they are an older snapshot's) (M7).

    A symbol that several pages list comes once, its non-compliance first (D5). If fetching or parsing fails the newest valid
    snapshot stands in; without one ValueError is raised.
    """
    from tapemill.sources.parsers import listing_snapshot

    try:
        rows = by_priority(listing_snapshot(pages(), refreshed_at), ["symbol"], "official_status", {"listed": 0, "non_compliant": 1}, ["source"])
        path = f"{folder}/listings_{rows.first()['snapshot_date'].isoformat()}.csv"
        _write_one_csv(rows.select(*SNAPSHOT).orderBy("symbol"), path)
        return read_snapshot(spark, path), "", False
    except Exception as error:  # noqa: BLE001  whatever keeps it from being refreshed
        kept, path = newest_snapshot(spark, folder)
        return kept, f"not refreshed ({str(error).splitlines()[0]}), {path} is used", True


def _write_one_csv(df: DataFrame, path: str) -> None:
    """A small table as one file, put in place at once (K1)."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    try:
        df.coalesce(1).write.option("header", True).option("escape", '"').csv(staged)
        part = fs.globStatus(at(f"{staged}/part-*"))[0].getPath()
        fs.delete(at(path), False)
        if not fs.rename(part, at(path)):
            raise OSError(f"could not put {path} in place")
    finally:
        fs.delete(at(staged), True)


def fetch(get: Callable[[str], tuple[int, str, str]], url: str, kind: str, attempts: int = 1) -> str:
    """A body through an injected getter (status, content type, body); anything but a full one of ``kind`` raises."""
    problem = ""
    for _ in range(attempts):
        status, content, body = get(url)
        problem = f"status {status}" if status != 200 else f"content type {content}" if kind not in content else "empty body" if not body.strip() else ""
        if not problem:
            return body
    raise ValueError(f"{url}: {problem}")
