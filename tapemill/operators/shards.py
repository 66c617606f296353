"""Time shards of entities that hold more rows than one task should.

An entity may hold a third of all rows. Its time line is then cut where its rows, counted by day, fill a shard; a day that
alone holds more is cut into equal times. Other entities are one shard. Only what is counted decides: no row is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
SHARD_ROWS = 262_144
#: Bounds of up to so many large entities, and so many in all, travel with the tasks; beyond it Spark joins them as it sees fit.
MOST_ENTITIES, MOST_BOUNDS = 1_000, 100_000


class Shards:
    """The bounds of large entities, from ``frames`` of (entity, at), times in microseconds."""

    def __init__(self, frames: list[DataFrame], rows: int = SHARD_ROWS):
        both = frames[0].select("entity", "at")
        for f in frames[1:]:
            both = both.unionByName(f.select("entity", "at"))
        days = both.groupBy("entity", F.floor(F.col("at") / DAY).alias("day")).agg(F.count("*").alias("n"))
        line = Window.partitionBy("entity").orderBy("day")
        before = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        days = days.withColumns({"total": F.sum("n").over(Window.partitionBy("entity")), "full": F.floor(before / rows), "slices": F.ceil(F.col("n") / rows).cast("int")}).where(F.col("total") > rows)
        new = (F.col("full") > F.lag("full").over(line)) | (F.lag("slices").over(line) > 1) | (F.col("slices") > 1)
        days = days.withColumn("new", F.coalesce(new, F.lit(False)))
        starts = F.transform(F.sequence(F.when(F.col("new"), 0).otherwise(1), F.col("slices") - 1), lambda i: F.col("day") * DAY + F.floor(i * F.lit(DAY) / F.col("slices")))
        bounds = days.where("new or slices > 1").select("entity", F.explode(starts).alias("bound")).groupBy("entity").agg(F.sort_array(F.collect_list("bound")).alias("bounds"))
        told = bounds.limit(MOST_ENTITIES + 1).collect()
        self.none = not told
        small = len(told) <= MOST_ENTITIES and sum(len(r["bounds"]) for r in told) <= MOST_BOUNDS
        self._bounds = F.broadcast(both.sparkSession.createDataFrame(told, bounds.schema)) if told and small else bounds

    def of(self, df: DataFrame) -> DataFrame:
        """``df`` (entity, at, ...) with ``shard``, from 0 on, and ``large``, whether the entity has several."""
        if self.none:
            return df.withColumns({"shard": F.lit(0), "large": F.lit(False)})
        b = self._bounds.withColumnRenamed("entity", "b_entity")
        at = F.coalesce(F.size(F.filter("bounds", lambda x: x <= F.col("at"))), F.lit(0))
        return df.join(b, F.col("entity").eqNullSafe(F.col("b_entity")), "left").withColumns({"shard": F.when(F.col("bounds").isNull(), 0).otherwise(at), "large": F.col("bounds").isNotNull()}).drop("b_entity", "bounds")

    def every(self) -> DataFrame:
        """(entity, shard) of all shards of the large entities."""
        return self._bounds.select("entity", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("shard"))
