"""Keep-last deduplication and what goes with it.

Every operator takes a total order: what "last" means must not depend on how rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ascending ``order``, nulls first; null keys are equal. Ties beyond it break anyhow.

    Spark limits each task to one row per key before the shuffle (window group limit), so many copies of one key do
    not meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys and the difference; nulls are values."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys")).withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))


def conflicts(df: DataFrame, keys: list[str], payload: list[str], newest: str, source: str) -> DataFrame:
    """Keys whose rows differ in ``payload`` (nulls compare as values): versions, distinct payloads, the newest source."""
    described = df.withColumn("_payload", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    per = described.groupBy(*keys, "_payload").agg(F.count("*").alias("n"), F.max(F.struct(newest, source)).alias("last"))
    return per.groupBy(*keys).agg(F.sum("n").alias("versions"), F.count("*").alias("payloads"), F.max("last")[source].alias("newest_source")).where("payloads > 1")


def by_priority(df: DataFrame, keys: list[str], status: str, priority: dict[str, int], order: list[str]) -> DataFrame:
    """The row of each key whose status ranks highest (unknown ones -1), the later on ties."""
    rank = F.lit(-1)
    for name, p in priority.items():
        rank = F.when(F.col(status) == name, p).otherwise(rank)
    return keep_last(df.withColumn("_priority", rank), keys, ["_priority", *order]).drop("_priority")


def assert_one(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, after checking that no key repeats; raises ValueError otherwise."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{what}: more than one row for {repeated[0].asDict()}")
    return df


def next_versions(models: DataFrame) -> DataFrame:
    """(model_scope, symbol, next_version): one more than the greatest, per scope and symbol."""
    return models.groupBy("model_scope", "symbol").agg((F.coalesce(F.max("model_version"), F.lit(0)) + 1).alias("next_version"))
