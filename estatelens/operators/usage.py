"""Usage of assets from a log: counts in a window that ends at a fixed time, last use, staleness."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

PLACED_ROWS = 200_000  # rows that one task orders


def latest(log: DataFrame, ts: str) -> dt.datetime:
    """The log's last time: the default end of windows. An empty log has none."""
    found = log.agg(F.max(ts)).first()[0]
    if found is None:
        raise ValueError("an empty log needs an explicit end time")
    return found


def usage_window(log: DataFrame, keys: list[str], ts: str, as_of: dt.datetime, days: int) -> DataFrame:
    """keys, last_used (over all rows) and used (rows from as_of - days up to as_of, both included)."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    inside = F.col(ts).between(F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of))
    return log.groupBy(*keys).agg(F.max(ts).alias("last_used"), F.count_if(inside).alias("used"))


def stale(log: DataFrame, keys: list[str], ts: str, as_of: dt.datetime, days: int) -> DataFrame:
    """Keys whose last use is `days` or more before as_of; keys without any row aren't reported."""
    last = log.groupBy(*keys).agg(F.max(ts).alias("last_used"))
    return last.filter(F.col("last_used") <= F.lit(as_of - dt.timedelta(days=days)))


def total_order(log: DataFrame, keys: list[str], placed_rows: int = PLACED_ROWS) -> DataFrame:
    """log with `place`: 1, 2, ... in the order of the keys over all rows.

    Rows are dealt to ranges of the keys, numbered within their range, and moved up by the
    rows of the ranges before. The log is written once, since ranges are drawn from a sample.
    """
    ranges = max(1, math.ceil(log.count() / placed_rows))
    dealt = log.drop("place").repartitionByRange(ranges, *keys) if ranges > 1 else log.drop("place").coalesce(1)
    dealt = written(dealt.withColumn("__range", F.spark_partition_id()), "order")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "__range").withColumn("place", (F.col("__before") + within).cast("long")).drop("__range", "__before")
