"""Usage of assets from a stream of log rows: counts by day with late rows bounded by a watermark, and last use kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(log: DataFrame, keys: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """day, keys and used; a day is final once the watermark has passed it."""
    days = log.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("used"))
    return days.select(F.col("w.start").alias("day"), *keys, "used")


def merge_last_used(held: DataFrame, batch: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The table of last uses after a batch: for foreachBatch, over the table written before."""
    new = batch.groupBy(*keys).agg(F.max(ts).alias("last_used"))
    return held.unionByName(new).groupBy(*keys).agg(F.max("last_used").alias("last_used"))
