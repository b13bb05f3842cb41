"""Query logs: Parquet with a fixed schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import usage
from ..schemas import QUERY_LOG, require_none


class QueryLogError(ValueError):
    """A log that doesn't keep its contract."""


def load_query_log(spark: SparkSession, path: str) -> DataFrame:
    """dashboard_id, tile_id, user, timestamp (naive times are UTC)."""
    log = spark.read.parquet(path)
    kinds = [f.dataType.typeName() for f in log.schema.fields]
    if log.columns != QUERY_LOG or kinds[:3] != ["string"] * 3 or not kinds[3].startswith("timestamp"):
        raise QueryLogError(f"{path}: expected {QUERY_LOG}, found {dict(zip(log.columns, kinds, strict=True))}")
    log = log.select(*[F.trim(c).alias(c) for c in QUERY_LOG[:3]], F.col("timestamp").cast("timestamp").alias("timestamp"))
    blank = F.exists(F.array(*QUERY_LOG[:3]), lambda x: F.coalesce(x == "", F.lit(True))) | F.col("timestamp").isNull()
    require_none(log.filter(blank).select(*QUERY_LOG[:3]), f"{path}: rows without a key", QueryLogError)
    return log


def log_totals(log: DataFrame) -> DataFrame:
    """One row: how many rows the log has, and its first and last time."""
    return log.agg(F.count(F.lit(1)).alias("log_rows"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def of_dashboard(log: DataFrame, dashboard_id: str) -> DataFrame:
    """The rows of one dashboard."""
    return log.filter(F.col("dashboard_id") == dashboard_id)


def with_evidence(log: DataFrame, path: str) -> DataFrame:
    at = hashing.utc_text(F.col("timestamp"))
    locator = F.concat(F.lit("dashboard_id="), "dashboard_id", F.lit("/tile_id="), "tile_id", F.lit("/timestamp="), at, F.lit("/user="), "user")
    pointer = F.struct(F.lit("query_log").alias("source"), F.lit(path).alias("uri"), locator.alias("locator"), hashing.row_hash(F.col("dashboard_id"), F.col("tile_id"), F.col("user"), at).alias("content_hash"), F.lit(None).cast("string").alias("excerpt"))
    return log.withColumn("evidence", pointer)


def usage_summaries(log: DataFrame, as_of: dt.datetime | None = None, days: int = 90) -> DataFrame:
    """dashboard_id, tile_id, last_queried_at and query_count_90d (rows in the window, whatever its days)."""
    as_of = as_of or usage.latest(log, "timestamp")
    out = usage.usage_window(log, ["dashboard_id", "tile_id"], "timestamp", as_of, days)
    return out.withColumnsRenamed({"last_used": "last_queried_at", "used": "query_count_90d"})


def write_query_log(log: DataFrame, path: str) -> None:
    """Sorted, compressed Parquet."""
    log.orderBy("timestamp", "dashboard_id", "tile_id", "user").write.mode("overwrite").option("compression", "zstd").parquet(path)
