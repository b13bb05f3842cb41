"""Row numbers within keys of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

RANGE_ROWS = 200_000  # rows that one task orders


def numbered(df: DataFrame, key: str, order: list[str], place: str, total: str, range_rows: int = RANGE_ROWS, rows: int | None = None, weight: str | None = None) -> DataFrame:
    """df with `place` (1, 2, ... within each key, in the given order) and `total` (the key's number of rows), both long.

    With a weight, a column of positive whole numbers, both are sums of it: the running one up to the row, and the key's.
    Rows are dealt to ranges of key and order, so that a key of any size is spread over many
    tasks. Only the first key of a range can have begun in one before it: the table of keys in
    several ranges has at most two rows for each range, and that is what is broadcast. Rows of
    one key that the order doesn't tell apart stay in one range. df is sampled first, and counted
    unless its number of rows is given; it should be cheap to read twice. An empty one stays empty.
    """
    each = F.lit(1) if weight is None else F.col(weight)
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((df.count() if rows is None else rows) / range_rows))
    dealt = written(df.repartitionByRange(ranges, key, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("__range", key).agg(F.sum(each).alias("__n"))
    whole = Window.partitionBy(key)  # a row for each range that holds the key
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spread = counts.select("__range", key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__all"), F.count(F.lit(1)).over(whole).alias("__ranges"))
    spread = spread.filter("__ranges > 1").select("__range", F.col(key).alias("__key"), "__before", "__all")
    own = Window.partitionBy("__range", key)
    rows = dealt.select("*", F.sum(each).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("__row"), F.sum(each).over(own).alias("__own"))
    same = (F.col("t.__range") == F.col("s.__range")) & F.col(f"t.{key}").eqNullSafe(F.col("s.__key"))
    both = rows.alias("t").join(F.broadcast(spread).alias("s"), same, "left")
    return both.select(*[F.col(f"t.`{c}`") for c in df.columns], (F.coalesce("__before", F.lit(0)) + F.col("__row")).cast("long").alias(place), F.coalesce("__all", "__own").cast("long").alias(total))
