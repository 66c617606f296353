"""Incremental ingest with Structured Streaming: new daily rows into the master table, windowed activity of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapemill.operators.dedup import keep_last
from tapemill.session import durable
from tapemill.sources.files import exists

BARS = "bar_id bigint, symbol string, feed string, date date, ldcp double, open double, high double, low double, close double, change double, change_percent double, volume bigint, load_id bigint, ingested_at timestamp_ntz"


def merge_batch(batch: DataFrame, target: str) -> None:
    """The target, partitioned by date, with the batch's rows: the last arrived of each (symbol, feed, date).

    Only partitions of the batch's dates are read and replaced; rows without a date have one of their own. Running it twice
    changes nothing.
    """
    spark = batch.sparkSession
    both = batch
    if exists(spark, target):
        dates = batch.select("date").distinct()
        stored = spark.read.schema(batch.schema).parquet(target)
        old = stored.join(dates.withColumnRenamed("date", "b_date"), F.col("date").eqNullSafe(F.col("b_date")), "left_semi")
        both = old.unionByName(batch)
    # Kept apart from the files it came from, which are about to be replaced.
    merged = durable(keep_last(both, ["symbol", "feed", "date"], ["ingested_at", "bar_id"]))
    merged.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target)


def ingest_available(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = BARS) -> StreamingQuery:
    """Take in every file of ``source`` that was not yet, then stop; the checkpoint remembers. Merging is idempotent, so a
    batch that is replayed after a failure does no harm."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window_start, kind, events, total) per tumbling window; for streams, rows later than ``late`` are dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    return stamped.groupBy(F.window(time, window), kind).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), kind, "events", "total")
