"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows fall into source partitions by a hash. How many rows each source sends to each
shard is drawn exactly: row p of the matrix is multivariate hypergeometric given what
the sources before it have drawn, so that its sums are the source sizes and the shard
sizes. Each source permutes its rows and cuts them by its row of the matrix; rows are
exchanged; each shard permutes what it has received. The result is a uniform shuffle
whose shard sizes differ by one at most. Only the matrix is made on the driver: sources
times shards whole numbers, of at most MOST_SOURCES sources. Sources and shards of any size are
permuted in cells of about BLOCK_ROWS rows, drawn at random, so no task orders a whole one.

Defined results: rows that are equal in every column used are interchangeable, and share a
cell; null ids and null texts are values like others; a very long text is a row like others; an
empty table gives an empty result; columns named like an output column are replaced by it, and
others may have any name.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import set_aside

MOST_SOURCES = 2048  # rows of the matrix; more rows make larger sources, in more cells
SOURCE_ROWS = 200_000
BLOCK_ROWS = 100_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good; numpy's sampler, and beyond its range inversion around the mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(max(1.0, mean * (bad / total) * ((total - draws) / max(1, total - 1))))
    a, b = max(low, int(mean - 40 * sd)), min(high, int(mean + 40 * sd) + 1)
    k = np.arange(a, b, dtype=np.float64)
    log_p = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1)))])
    p = np.exp(log_p - log_p.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each source to each shard; sums over rows and columns are exact."""
    if sum(sources) != sum(shards):
        raise ValueError("sources and shards must hold the same number of rows")
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in sources:
        row, rest, draws = [], sum(left), n
        for room in left:
            rest -= room
            got = hypergeometric(rng, room, rest, draws)
            row.append(got)
            draws -= got
        left = [room - got for room, got in zip(left, row, strict=True)]
        out.append(row)
    return out


def shuffle_shards(df: DataFrame, shards: int, key: list[str], seed: int = 17) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard), in DataFrame operations only.

    key: columns by which rows are told apart; they seed the random order, so that every
    evaluation draws the same. Select only the columns that have to travel before the call.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    df = df.drop("shard", "slot")
    key = [f"__aside_{df.columns.index(c)}" for c in key]
    df, named = set_aside(df, [])
    spark, rows = df.sparkSession, df.count()
    sources = min(MOST_SOURCES, max(64, math.ceil(rows / SOURCE_ROWS)))

    def draw(salt: str) -> Column:
        return F.xxhash64(F.lit(f"{seed}/{salt}"), *[F.col(c) for c in key])

    def permuted(df: DataFrame, group: str, groups: int, least: int, salt: str) -> DataFrame:
        """df with `__at`: 0, 1, ... within its group, at random."""
        cells = max(least, math.ceil(rows / groups / BLOCK_ROWS))
        within = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(draw(salt), *key)) - 1
        if cells == 1:
            return df.withColumn("__at", within(group).cast("long"))
        df = df.withColumn("__cell", F.pmod(draw(f"{salt} cell"), F.lit(cells)).cast("int"))
        before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = df.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
        offsets = offsets.select(group, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        return df.join(offsets, [group, "__cell"]).withColumn("__at", (F.col("__before") + within(group, "__cell")).cast("long")).drop("__cell", "__before")

    df = df.withColumn("__source", F.pmod(draw("source"), F.lit(sources)).cast("int"))
    held = {r[0]: r[1] for r in df.groupBy("__source").count().collect()}
    matrix = communication_matrix([held.get(p, 0) for p in range(sources)], shard_sizes(rows, shards), seed)
    ends = json.dumps([np.cumsum(row).tolist() for row in matrix])
    cuts = spark.range(1).select(F.posexplode(F.from_json(F.lit(ends), "array<array<bigint>>")).alias("__source", "__ends"))

    sent = permuted(df, "__source", sources, 1, "local").join(F.broadcast(cuts), "__source")  # MOST_SOURCES rows at most
    sent = sent.withColumn("shard", F.size(F.filter("__ends", lambda end: end <= F.col("__at")))).drop("__source", "__ends", "__at")
    return named(permuted(sent, "shard", shards, 32, "slot").withColumnRenamed("__at", "slot"), "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard, with files of runs of BLOCK_ROWS slots in their order, so that no task holds a shard."""
    df.repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 16).cast("long")


def _crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit(""))).cast("long")


def sharded_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, text, shard and slot: the documents themselves, dealt to shards."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), _crc32(text).alias("text_crc32"), _size(text).alias("size"))
    return shuffle_shards(rows, shards, ["doc_id", "text_crc32", "size"], seed).select("doc_id", "text", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Size, checksum, shard and slot of every document, taken from the documents in their shards, under the law `rows`: counts differ by one at most."""
    out, text = sharded_documents(docs, shards, seed), F.col("text")
    return out.select("doc_id", _size(text).alias("size"), _crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
