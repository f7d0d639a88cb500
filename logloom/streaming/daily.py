"""Daily log statistics as a stream (an extension: batch tools keep a file for each day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", delay: str = "1 day") -> DataFrame:
    """Events of each kind by day; late ones count until the watermark has passed."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    counted = stamped.withWatermark("__ts", delay).groupBy(F.window("__ts", "1 day"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("day"), kind, "n")
