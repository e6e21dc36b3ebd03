"""Daily statistics kept current over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stats(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """min_val, max_val, avg_val and std_val of each series and day of a stream of readings (ts as
    timestamp), final once the watermark has passed the day."""
    day = F.window("ts", "1 day")
    out = stream.withWatermark("ts", late).groupBy("task_id", "channel_id", day.alias("w")).agg(F.min("value").alias("min_val"), F.max("value").alias("max_val"), F.avg("value").alias("avg_val"), F.stddev_samp("value").alias("std_val"))
    return out.select("task_id", "channel_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "min_val", "max_val", "avg_val", "std_val")
