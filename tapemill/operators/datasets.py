"""Leakage-safe datasets: builds, chronological splits, training-only scaling, readiness and model status."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapemill.operators import indicators, indices, quality, registry
from tapemill.operators.dedup import keep_last
from tapemill.sources import files

MINIMUM_ROWS = 252
#: Types a master dataset may hold.
MASTER_TYPES = ("ordinary_equity", "preference_share", "gem_equity", "etf", "other")
PROPORTIONS = (0.70, 0.15, 0.15)


def feature_version(spec: dict) -> str:
    """A version that follows from the specification's content."""
    return "tm-1-" + hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:12]


VERSION = feature_version({"features": list(indicators.FEATURES), "warmup": indicators.WARMUP, "context": list(indices.CONTEXT)})
#: What a dataset holds besides features, in its order.
METADATA = ("is_active", "official_status", "lifecycle_status", "security_type")
COLUMNS = ("symbol", "date", *indicators.RAW, "simple_return", "log_return", "high_low_range", "open_close_return", *(c for c in indicators.INDICATORS if c != "true_range"), *METADATA, *indices.CONTEXT, "feature_version")


def prepared(bars: DataFrame, reg: DataFrame, context: DataFrame | None = None, tolerance_days: int = 0) -> DataFrame:
    """Features of symbols without fatal faults, with their registry metadata and the market's context.

    Symbols are trimmed first, so that spellings of one are one series. ``context``: see ``indices.context``; each row gets
    that of its date, or of the latest date up to ``tolerance_days`` before. Without it the context's columns are null.
    """
    trimmed = bars.withColumn("symbol", F.trim("symbol"))
    fatal = quality.fatal_errors(trimmed).select("symbol")
    sound = trimmed.where("symbol <> ''").join(fatal, "symbol", "left_anti")
    rows = registry.attach(indicators.calculate_features(sound), reg).withColumn("feature_version", F.lit(VERSION))
    if context is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in indices.CONTEXT})
    return indices.join_context(rows, context.select("date", *indices.CONTEXT), tolerance_days).drop("context_date")


def dataset_rows(features: DataFrame) -> DataFrame:
    """The columns of a dataset, in its order, of rows of :func:`symbol_datasets` or :func:`master_dataset`."""
    return features.select(*COLUMNS)


def symbol_datasets(features: DataFrame, least: int = MINIMUM_ROWS) -> DataFrame:
    """Usable rows of active ordinary equities with at least ``least`` of them."""
    rows = indicators.usable_rows(features).where("is_active and security_type = 'ordinary_equity'")
    enough = rows.groupBy("symbol").count().where(F.col("count") >= least).select("symbol")
    return rows.join(enough, "symbol", "left_semi")


def skipped_symbols(features: DataFrame, built: DataFrame) -> DataFrame:
    return features.select("symbol").distinct().join(built.select("symbol").distinct(), "symbol", "left_anti")


def master_dataset(features: DataFrame) -> DataFrame:
    """Usable rows of every supported type."""
    return indicators.usable_rows(features).where(F.col("security_type").isin(list(MASTER_TYPES)))


def _check(proportions: Sequence[float]) -> None:
    if len(proportions) != 3 or min(proportions) <= 0 or abs(sum(proportions) - 1) > 1e-9:
        raise ValueError("three positive proportions that sum to 1 are needed")


def split_label(number: Column, n: Column, proportions: Sequence[float] = PROPORTIONS) -> Column:
    """Which part the ``number``-th of ``n`` dates is in; null below three dates."""
    train, val = (F.greatest(F.lit(1), F.floor(n * F.lit(float(p))).cast("int")) for p in proportions[:2])
    full = train + val >= n
    train, val = F.when(full, n - 2).otherwise(train), F.when(full, 1).otherwise(val)
    return F.when(n >= 3, F.when(number <= train, "train").when(number <= train + val, "validation").otherwise("test"))


def chronological_split(data: DataFrame, scope: str, proportions: Sequence[float] = PROPORTIONS) -> DataFrame:
    """Adds ``split`` by date boundaries, over all symbols (``master``) or for each (``symbol``).

    Only distinct dates are ranked, one row per calendar day; with fewer than three of them the split is null. For one
    dataset, where that is an error, see :func:`checked_split`.
    """
    _check(proportions)
    if scope not in ("master", "symbol"):
        raise ValueError(f"unknown scope {scope}")
    keys = ["symbol"] if scope == "symbol" else []
    dates = data.where("date is not null").select(*keys, "date").distinct()
    w = Window.partitionBy(*keys)
    labelled = dates.withColumns({"_k": F.row_number().over(w.orderBy("date")), "_n": F.count("*").over(w)})
    return data.join(labelled.select(*keys, "date", split_label(F.col("_k"), F.col("_n"), proportions).alias("split")), [*keys, "date"], "left")


def checked_split(data: DataFrame, scope: str, proportions: Sequence[float] = PROPORTIONS) -> DataFrame:
    """:func:`chronological_split` of one dataset; ValueError below three dates or, for a symbol's, with several symbols."""
    told = data.where("date is not null").agg(F.count_distinct("date").alias("dates"), F.count_distinct("symbol").alias("symbols")).first()
    if told["dates"] < 3 or (scope == "symbol" and told["symbols"] != 1):
        raise ValueError(f"{told['dates']} dates of {told['symbols']} symbols cannot be split by {scope}")
    return chronological_split(data, scope, proportions)


def split_metadata(split: DataFrame) -> DataFrame:
    """(split, first and last date, rows, sorted symbols) of each part."""
    return split.where("split is not null").groupBy("split").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def fit_scaler(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation (1 where nothing varies) of each column over the training part, and counts of
    the training rows and of rows, of any part, with a value that is no finite number."""
    train = F.col("split") == "train"
    bad = F.lit(False)
    out = []
    for c in columns:
        x = F.when(train, F.col(c).cast("double"))
        s = F.stddev_pop(x)
        out += [F.avg(x).alias(f"mean_{c}"), F.when(s > 0, s).otherwise(1.0).alias(f"scale_{c}")]
        bad |= F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return split.where("split is not null").agg(F.count_if(train).alias("training_rows"), F.count_if(bad).alias("non_finite_rows"), *out)


def scale(split: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns standardised by the fitted row; a row that was fitted over values that are no finite numbers raises as it is used."""
    sound = F.when(F.col("non_finite_rows") == 0, F.col("training_rows")).otherwise(F.raise_error(F.lit("a scaler needs finite values in every part")).cast("bigint"))
    both = split.join(F.broadcast(scaler.withColumn("training_rows", sound)))  # one row
    checked = both.where("training_rows >= 0")
    return checked.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}") for c in columns}).drop(*scaler.columns)


def scaler_rows(scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, scale, training_rows) of a fitted row, the form in which it is kept (K3)."""
    return scaler.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"scale_{c}").alias("scale"), "training_rows") for c in columns])))


def persist_split(split: DataFrame, columns: Sequence[str], folder: str) -> dict[str, DataFrame]:
    """Writes ``raw`` and ``scaled`` rows partitioned by split, the ``scaler`` and the ``metadata`` of the parts, and reads them
    again (M15, K3). Values that are no finite numbers raise and nothing is written.
    """
    rows = split.where("split is not null")
    fitted = fit_scaler(rows, columns)
    told = fitted.first()
    if told["non_finite_rows"] or not told["training_rows"]:
        raise ValueError(f"{told['non_finite_rows']} rows with values that are no finite numbers, {told['training_rows']} training rows")
    parts = {"raw": rows, "scaled": scale(rows, rows.sparkSession.createDataFrame([told], fitted.schema), columns), "scaler": scaler_rows(fitted, columns), "metadata": split_metadata(rows)}
    for name, part in parts.items():
        files.replace_table(part, f"{folder}/{name}", partition_by=["split"] if name in ("raw", "scaled") else [])
    return {name: rows.sparkSession.read.parquet(f"{folder}/{name}") for name in parts}


def eligibility(bars: DataFrame, reg: DataFrame, features: DataFrame, least: int = MINIMUM_ROWS) -> DataFrame:
    """(symbol, usable_rows, eligible, reason): quality, inactive, type, history, in this order."""
    usable = indicators.usable_rows(features).groupBy("symbol").agg(F.count("*").alias("usable_rows"))
    faults = quality.fatal_errors(bars)
    one = registry.attach(bars.select("symbol").where("trim(symbol) <> ''").distinct(), reg)
    rows = one.join(usable, "symbol", "left").join(faults, "symbol", "left").withColumn("usable_rows", F.coalesce("usable_rows", F.lit(0)))
    reason = F.when(F.col("errors").isNotNull(), "data_quality_issue").when(~F.col("is_active"), "inactive").when(F.col("security_type") != "ordinary_equity", "unsupported_security_type").when(F.col("usable_rows") < least, "insufficient_history").otherwise("")
    return rows.select("symbol", "usable_rows", (reason == "").alias("eligible"), reason.alias("reason"))


def _active(reg: DataFrame) -> DataFrame:
    return reg.where(F.col("officially_listed") & (F.col("activity_status") == "recently_traded") & (F.trim("symbol") != ""))


def readiness(bars: DataFrame, reg: DataFrame, features: DataFrame, built: DataFrame, least: int = MINIMUM_ROWS) -> DataFrame:
    """One row per active symbol: raw and usable rows, the gap to ``least``, split sizes if ready, and the status.

    ``features``: symbol, is_warmup and is_complete suffice. ``built``: the processed rows (symbol, date). Quality, type, history, missing dataset, inconsistent dataset, Ready.
    """
    raw = bars.groupBy("symbol").agg(F.count("*").alias("raw_trading_rows"), F.min("date").alias("earliest_raw_date"), F.max("date").alias("latest_raw_date"))
    made = features.groupBy("symbol").agg(F.count_if("is_warmup").alias("warmup_rows_removed"), F.count_if(~F.col("is_warmup") & F.col("is_complete")).alias("usable_feature_rows"))
    parts = chronological_split(built.select("symbol", "date"), "symbol").groupBy("symbol").agg(F.bool_and(F.col("date").isNotNull()).alias("consistent"), *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")])
    rows = _active(reg).select("symbol", "company_name", "security_type").join(raw, "symbol", "left").join(made, "symbol", "left").join(quality.fatal_errors(bars), "symbol", "left").join(parts, "symbol", "left")
    rows = rows.na.fill(0, ["raw_trading_rows", "warmup_rows_removed", "usable_feature_rows", "train_rows", "validation_rows", "test_rows"])
    status = (
        F.when(F.col("errors").isNotNull(), "Data Quality Issue").when(F.col("security_type") != "ordinary_equity", "Unsupported Security Type").when(F.col("usable_feature_rows") < least, "Insufficient History")
        .when(F.col("consistent").isNull(), "Missing Processed Dataset").when(~F.col("consistent") | (F.col("test_rows") == 0), "Data Quality Issue").otherwise("Ready")
    )
    rows = rows.withColumn("readiness_status", status)
    ready = lambda c: F.when(F.col("readiness_status") == "Ready", F.col(c)).otherwise(0).alias(c)
    return rows.select("symbol", "company_name", "raw_trading_rows", "earliest_raw_date", "latest_raw_date", "warmup_rows_removed", "usable_feature_rows", F.lit(least).alias("minimum_usable_rows"), F.greatest(F.lit(0), least - F.col("usable_feature_rows")).alias("additional_rows_required"), ready("train_rows"), ready("validation_rows"), ready("test_rows"), "readiness_status")


def latest_models(models: DataFrame) -> DataFrame:
    """The latest version of each (model_scope, symbol)."""
    return keep_last(models, ["model_scope", "symbol"], ["model_version", "model_id"])


def new_days(bars: DataFrame, models: DataFrame) -> DataFrame:
    """(symbol, new_data_days): distinct dates after the model's training end; 0 where there is none."""
    days = bars.where("date is not null").groupBy("symbol", "date").agg(F.lit(1).alias("one"))
    both = days.join(models.select("symbol", "training_data_end"), "symbol")
    return both.groupBy("symbol").agg(F.count_if(F.col("date") > F.col("training_data_end")).alias("new_data_days"))


def symbol_status(bars: DataFrame, reg: DataFrame, models: DataFrame, least: int = MINIMUM_ROWS) -> DataFrame:
    """One row per active symbol with its latest model's staleness.

    usable_rows here are distinct dates less the warm-up. Quality, type, history, never trained, failed, new days.
    """
    latest = latest_models(models.where("model_scope = 'symbol'"))
    days = bars.where("date is not null").groupBy("symbol", "date").agg(F.lit(1).alias("one")).groupBy("symbol").agg(F.min("date").alias("data_start"), F.max("date").alias("data_end"), F.greatest(F.lit(0), F.count("*") - indicators.WARMUP).alias("usable_rows"))
    rows = _active(reg).select("symbol", "company_name", "security_type", "is_new_listing").join(days, "symbol", "left").join(quality.fatal_errors(bars), "symbol", "left").join(latest.select("symbol", "model_version", "model_status", "training_data_end"), "symbol", "left").join(new_days(bars, latest), "symbol", "left")
    rows = rows.na.fill(0, ["usable_rows", "new_data_days"])
    ordinary, enough = F.col("security_type") == "ordinary_equity", F.col("usable_rows") >= least
    status = (
        F.when(F.col("errors").isNotNull(), "data_quality_issue").when(~ordinary, "unsupported_security_type").when(~enough, "insufficient_history").when(F.col("model_version").isNull() | (F.col("model_status") == "not_trained"), "never_trained")
        .when(F.col("model_status") == "failed", "training_failed").when(F.col("new_data_days") > 0, "retraining_recommended").otherwise("up_to_date")
    )
    return rows.select("symbol", "company_name", "security_type", F.lit(True).alias("is_active"), F.col("is_new_listing").alias("is_newly_added"), "data_start", "data_end", "usable_rows", (F.col("errors").isNull() & ordinary & enough).alias("eligible"), "model_version", "training_data_end", "new_data_days", (F.col("new_data_days") > 0).alias("needs_retraining"), status.alias("training_status"), F.coalesce("errors", F.lit("")).alias("quality_errors"))


def combined_status(status: DataFrame, ready: DataFrame) -> DataFrame:
    """Status with readiness' usable rows, and its missing dataset as the training status."""
    r = ready.select("symbol", F.col("usable_feature_rows").alias("r_usable"), "readiness_status")
    both = status.join(r, "symbol", "left")
    lost = F.col("readiness_status") == "Missing Processed Dataset"
    return both.withColumns({"usable_rows": F.coalesce("r_usable", "usable_rows"), "training_status": F.when(lost, "missing_processed_dataset").otherwise(F.col("training_status"))}).drop("r_usable")


def master_status(dataset: DataFrame, models: DataFrame) -> DataFrame:
    """One row for the master model: rows, symbols, latest date, the last version and days since."""
    last = latest_models(models.where("model_scope = 'master'")).agg(F.max("model_version").alias("model_version"), F.max("model_status").alias("model_status"), F.max("training_data_end").alias("training_data_end"))
    days = dataset.groupBy("date").agg(F.count("*").alias("n"))
    both = days.join(F.broadcast(last))  # one row
    rows = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("date").alias("latest_date"), F.max("model_version").alias("model_version"), F.max("model_status").alias("model_status"), F.count_if(F.col("date") > F.col("training_data_end")).alias("new_data_days"))
    status = F.when(F.col("rows") == 0, "missing_processed_dataset").when(F.col("model_version").isNull() | (F.col("model_status") == "not_trained"), "never_trained").when(F.col("model_status") == "failed", "training_failed").when(F.col("new_data_days") > 0, "retraining_recommended").otherwise("up_to_date")
    return rows.withColumn("training_status", status)


def complete_history(dataset: DataFrame) -> DataFrame:
    """(symbol, first and last date, rows) for training on everything there is."""
    return dataset.groupBy("symbol").agg(F.min("date").alias("training_data_start"), F.max("date").alias("training_data_end"), F.count("*").alias("training_rows"))


#: States of a model record.
MODEL_STATUSES = ("not_trained", "training", "trained", "failed", "archived")


def model_id(scope: Column, identity: Column, version: Column) -> Column:
    return F.format_string("ppo-%s-%s-v%04d", scope, F.regexp_replace(identity, "[^A-Za-z0-9._-]+", "_"), version)


def new_models(models: DataFrame, wanted: DataFrame, version: str = VERSION) -> DataFrame:
    """Records of new, untrained models for each (model_scope, symbol) of ``wanted``, in the registry's columns.

    Versions follow the greatest of their scope and symbol. A master model has no symbol; a symbol model without one, or an
    unknown scope, raises ValueError. Columns of ``wanted`` that the registry has are taken over, others raise.
    """
    unknown = sorted(set(wanted.columns) - set(files.MODELS))
    told = wanted.agg(F.count_if(~F.col("model_scope").isin("symbol", "master")).alias("scopes"), F.count_if((F.col("model_scope") == "symbol") & (F.coalesce(F.trim("symbol"), F.lit("")) == "")).alias("symbols")).first()
    if unknown or told["scopes"] or told["symbols"]:
        raise ValueError(f"new models: unknown {', '.join(unknown)}" if unknown else "new models: unknown scope, or no symbol")
    named = F.when(F.col("model_scope") == "symbol", F.trim("symbol"))
    last = models.withColumn("m_symbol", named).groupBy(F.col("model_scope").alias("m_scope"), "m_symbol").agg(F.max("model_version").alias("last"))
    rows = wanted.withColumn("symbol", named).join(last, (F.col("model_scope") == F.col("m_scope")) & F.col("symbol").eqNullSafe(F.col("m_symbol")), "left")
    number = (F.coalesce("last", F.lit(0)) + 1).cast("int")
    identity = F.coalesce("symbol", F.lit("master"))
    folder = F.format_string("%s/v%04d", F.when(F.col("model_scope") == "symbol", F.concat(F.lit("symbols/"), F.regexp_replace(identity, "[^A-Za-z0-9._-]+", "_"))).otherwise("master"), number)
    fixed = {
        "model_id": model_id(F.col("model_scope"), identity, number), "model_version": number.cast("bigint"), "model_status": F.lit("not_trained"), "training_status": F.lit("never_trained"), "feature_version": F.lit(version), "new_data_days": F.lit("0"), "needs_retraining": F.lit(False),
        "model_path": F.concat(folder, F.lit("/model")), "scaler_path": F.concat(folder, F.lit("/scaler")), "metrics_path": F.concat(folder, F.lit("/metrics")),
    }
    made = rows.withColumns({c: v for c, v in fixed.items() if c not in wanted.columns})
    return files.projected(made, files.MODELS, files.MODEL_TYPES)


def append_model(models: DataFrame, record: DataFrame) -> DataFrame:
    """``models`` with the new records; raises ValueError if an id is there already or a status is unknown."""
    if record.where(~F.col("model_status").isin(list(MODEL_STATUSES))).limit(1).count():
        raise ValueError("unknown model status")
    if record.join(models.select("model_id"), "model_id", "left_semi").limit(1).count():
        raise ValueError("model id exists")
    return models.unionByName(record, allowMissingColumns=True)


def select_models(status: DataFrame, search: str = "", types: Sequence[str] = (), states: Sequence[str] = (), newly_added: bool = False) -> DataFrame:
    """Candidates by literal text, types, training states and novelty; empty lists filter nothing."""
    out = status
    if search:
        out = out.where(F.lower("symbol").contains(search.lower()) | F.lower("company_name").contains(search.lower()))
    if types:
        out = out.where(F.col("security_type").isin(list(types)))
    if states:
        out = out.where(F.col("training_status").isin(list(states)))
    return out.where("is_newly_added") if newly_added else out


#: The bulk selections by name (F10), from the rows that are in view.
SELECTORS = {
    "visible": "true",
    "active_eligible": "is_active and eligible",
    "new_eligible": "is_newly_added and eligible",
    "needs_retraining": "needs_retraining and eligible",
    "never_trained": "training_status = 'never_trained' and eligible",
}


def bulk_select(status: DataFrame, name: str) -> DataFrame:
    return status.where(SELECTORS[name]).select("symbol").distinct()
