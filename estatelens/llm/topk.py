"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code is the signs of its components. Codes are cut into segments, and each
segment has an index from its value to the codes that hold it. A search looks up each
segment's values within a radius that grows from 0; after segment j at radius r every
code within distance segments * r + j is known to have been met (by the pigeonhole
principle), so it stops as soon as the k-th verified distance is that small, and the result
is exact.

Codes are dealt to shards of bounded size, each with its own index; the stated queries come to
every shard in blocks, packed as bytes. A task builds a shard's index once, streams up to
BLOCKS_A_TASK blocks of queries past it, and holds one of them at a time; only where there are
more does another task build that index again. The best k of each shard are merged.

Ties go to the smaller id. Defined results: a null or empty vector, and one with a null
component, is neither found nor searched for; null ids are not searched for and come last; a
query meets itself, at distance 0; rows that are equal are found as often as they occur, and
asked once; rows of one id with different codes are queries with a list each; vectors of
different lengths are an error; columns besides the id and the vector play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LAST

SHARD_CODES = 1 << 17
BLOCK_QUERIES = 2048
BLOCKS_A_TASK = 64


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as bytes, padded with zeros to whole pairs of bytes."""
    wide = -(-signs.shape[1] // 16) * 16
    return np.packbits(np.pad(signs, ((0, 0), (0, wide - signs.shape[1]))), axis=1)


def masks(bits: int) -> list[np.ndarray]:
    """All values of so many bits, by the number of ones."""
    values = np.arange(1 << bits, dtype=np.uint32)
    ones = np.bitwise_count(values)
    return [values[ones == r] for r in range(bits + 1)]


class MultiIndex:
    """Codes of one shard, indexed by each segment."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids = codes, ids
        self.bits = 16 if len(codes) >= 1 << 14 else 8
        self.segments = self._cut(codes)
        self.order, self.start = [], []
        for column in self.segments.T:
            order = np.argsort(column, kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(column[order], np.arange((1 << self.bits) + 1)))
        self.masks = masks(self.bits)

    def _cut(self, codes: np.ndarray) -> np.ndarray:
        return codes if self.bits == 8 else np.ascontiguousarray(codes).view(">u2").astype(np.uint16)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest, by distance and then id."""
        own = self._cut(query[None])[0]
        m, n = len(own), len(self.codes)
        seen = np.zeros(n, bool)
        dist, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(self.bits + 1):
            for j in range(m):
                values = self.masks[r] ^ own[j]
                low, high = self.start[j][values], self.start[j][values + 1]
                counts = high - low
                total = int(counts.sum())
                if total:
                    ends = np.cumsum(counts)
                    found = self.order[j][np.arange(total) + np.repeat(low - (ends - counts), counts)]
                    found = found[~seen[found]]
                    seen[found] = True
                    d = np.bitwise_count(self.codes[found] ^ query).sum(axis=1, dtype=np.int64)
                    dist, at = self._best(np.concatenate([dist, d]), np.concatenate([at, found]), k)
                if len(at) >= min(k, n) and dist[-1] <= m * r + j:  # beyond this place nothing as near is left, ties included
                    return dist, self.ids[at]
        return dist, self.ids[at]

    def _best(self, dist: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(dist) > 4 * k:
            keep = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
            dist, at = dist[keep], at[keep]
        order = np.lexsort((self.ids[at], dist))[:k]
        return dist[order], at[order]


def _packed(df: DataFrame, key: str, vector: str, id_col: str) -> DataFrame:
    """Groups of rows as one row each: ids and codes as bytes."""

    def pack_group(group: pa.Table) -> pa.Table:
        flat = group.column(vector).combine_chunks()
        n = group.num_rows
        values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64)
        codes = pack((values > 0).reshape(n, len(values) // n))
        ids = group.column(id_col).to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        return pa.table({key: group.column(key).slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "codes": pa.array([codes[order].tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    return df.groupBy(key).applyInArrow(pack_group, f"{key} int, ids binary, codes binary, n bigint")


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance: the k rows nearest to each query in Hamming distance of sign codes."""
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    rows = rows.filter(whole).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(vector).alias("v"))
    queries = queries.filter(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: (x > 0).cast("float")).alias("v")).distinct()
    n, widths = rows.agg(F.count(F.lit(1)), F.collect_set(F.size("v"))).first()
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)[:5]}")
    n_queries = queries.count()
    shards, blocks = max(1, min(8, n // 4096), math.ceil(n / SHARD_CODES)), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    deal = lambda df, parts, name: df.withColumn(name, F.pmod(F.xxhash64(F.lit(name), "id", "v"), F.lit(parts)).cast("int"))
    groups = math.ceil(blocks / BLOCKS_A_TASK)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    index = _packed(deal(rows, shards, "shard"), "shard", "v", "id").select("shard", every(groups, "group"), F.lit(-1).alias("block"), "ids", "codes", "n")
    asked = _packed(deal(queries, blocks, "block"), "block", "v", "id").select(every(shards, "shard"), F.floor(F.col("block") / BLOCKS_A_TASK).cast("int").alias("group"), "block", "ids", "codes", "n")

    def search(batches):
        at, multi = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1)
                if row["block"] < 0:  # a shard comes before its queries
                    at, multi = (row["shard"], row["group"]), MultiIndex(codes, ids)
                    continue
                if at != (row["shard"], row["group"]):
                    continue  # a shard without codes
                out = [multi.search(q, k) for q in codes]
                sizes = [len(d) for d, _ in out]
                query = pa.array([q.tobytes() for q in codes], pa.binary()).take(pa.array(np.repeat(np.arange(len(codes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), query, pa.array(np.concatenate([i for _, i in out])), pa.array(np.concatenate([d for d, _ in out]))], names=["query_id", "query", "neighbour_id", "distance"])

    met = index.union(asked).repartition(min(65536, shards * groups), "shard", "group").sortWithinPartitions("shard", "group", "block")
    found = met.mapInArrow(search, "query_id bigint, query binary, neighbour_id bigint, distance bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "neighbour_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.when(F.col("neighbour_id") != LAST, F.col("neighbour_id")).alias("neighbour_id"), "distance")


def search_embeddings(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The rows whose id is a multiple of `every` against all rows."""
    return nearest_codes(vectors, vectors.filter(F.col("vec_id") % every == 0), k)


ORACLE_SQL = """
with c as (select vec_id, list_transform(embedding, lambda x: x > 0) as code from embeddings where embedding is not null),
q as (select distinct vec_id, code from c where vec_id % 100 = 0),
d as (select q.vec_id as query_id, q.code, r.vec_id as neighbour_id,
             cast(len(list_filter(list_zip(q.code, r.code), lambda p: p[1] <> p[2])) as bigint) as distance
      from q, c r),
k as (select *, cast(row_number() over (partition by query_id, code order by distance, neighbour_id) as integer) as rank from d)
select query_id, rank, neighbour_id, distance from k where rank <= 10
"""
