"""Hashes of rows and of whole tables, independent of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' texts, joined by bars; nulls are left out."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


LANES = 4  # numbers of 15 hexadecimal digits from each row's hash


def table_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row, `fingerprint`: a digest of the table's rows, the same in any order.

    The hashes of the rows are cut into LANES numbers, which are added up; the digest is that
    of the number of rows and the sums. So every task sends one row, whatever the table's size.
    """
    rows = df.select(row_hash(*[F.col(c) for c in columns]).alias("h"))
    lane = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(28,0)")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(lane(k)), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(LANES)])
    return sums.select(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("fingerprint"))
