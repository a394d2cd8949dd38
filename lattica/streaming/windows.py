"""Event-time aggregates of an acquisition log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_outcomes(events: DataFrame, ts: str, by: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, sum and maximum for each tumbling window and kind; works on static and streaming frames alike.

    The watermark bounds the state of a stream; on a static frame it has no effect.
    """
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = rows.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("best"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "total", "best")
