"""Incremental profile and drift of a stream: watermarked windows, late data dropped after the delay.

State is bounded by windows and groups; distinct users are counted with a sketch per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def timed(events: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with its watermarked time ``_t``; one that has it keeps it, as a second watermark is not allowed."""
    return events if "_t" in events.columns else events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)


def windowed_profile(events: DataFrame, time: str = "ts", group: str = "event_type", name: str = "value", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, gaps, moments and extrema per window and group; works on a stream and on a table alike."""
    v = F.when(~F.isnan(F.col(name)), F.col(name))
    e = timed(events, time, delay)
    g = e.groupBy(F.window("_t", width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("std_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))
    return g.select(F.col("w.start").alias("window_start"), group, "n", "nulls", "mean_value", "std_value", "min_value", "max_value")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row per session of a key: events closer than the gap belong together."""
    e = timed(events, time, delay)
    g = e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key once, as far as its copies come within the delay; the watermarked time ``_t`` stays for later steps."""
    return timed(events, time, delay).dropDuplicatesWithinWatermark([key])


def drift_sink(reference: DataFrame, label: str, out: str):
    """A ``foreachBatch`` function that appends each batch's label divergence from the reference shares to a folder."""
    from cairn.operators.drift import divergence, shares

    base = reference.select(label).withColumn("_s", F.lit(True))

    def go(batch: DataFrame, epoch: int) -> None:
        both = base.union(batch.select(label).withColumn("_s", F.lit(False)))
        divergence(shares(both, label, F.col("_s"))).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return go
