"""Daily bars from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """open, close, high, low, volume and amount of each user and day of a stream of (user_id, ts, event_id, value).

    A day is put out when the watermark passes its end; events that come later than that are dropped by it.
    The same function works on a table, where it gives every day."""
    at = F.struct("ts", "event_id")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").cast("string").alias("instrument"))
    g = d.agg(F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("volume"), F.sum("value").alias("amount"))
    return g.select("instrument", F.to_date("w.start").alias("datetime"), "open", "close", "high", "low", "volume", "amount")
