"""What the operators share: the shared folder, written tables, chunks of documents and hashes of words."""

from __future__ import annotations

import math
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST = 2**63 - 1  # stands for a null id in orders: null ids come last
_CHUNK, _TEXT, _ID = "__chunk", "__text", "__id"
ROW_BYTES = 64  # what a row counts besides its text
SORTED_IDS, SORTED_BYTES = 500_000, 16 << 20  # that a task puts in order
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a setting of Spark: a query's shuffle files go when it ends


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="estatelens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/estatelens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, any executor may be lost.

    sweep: its shuffle files go with the write, else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(SWEEP, "false")
    try:
        if sweep:
            spark.conf.set(SWEEP, "true")
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.set(SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables; whatever was derived from them must be written by then."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(docs: DataFrame, used: list[str]):
    """docs with the columns that aren't used under names of their own, and a function that gives the names back to a result that holds them all."""
    names = docs.columns
    own = [n if n in used else f"__aside_{i}" for i, n in enumerate(names)]
    return docs.toDF(*own), lambda df, *more: df.select(*own, *more).toDF(*names, *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(name: str, key, make: Callable):
    """What make gives, kept in the Python process between tasks: one thing in all, that of the last name and key, since processes outlive the stages of a pipeline."""
    held = sys.modules.setdefault("_estatelens_held", types.ModuleType("_estatelens_held")).__dict__.setdefault("kept", {})
    if name not in held or held[name][0] != key:
        held.clear()
        held[name] = key, make()
    return held[name][1]


def parts(n_bytes: int, each: int, least: int) -> int:
    return max(least, math.ceil(n_bytes / each))


def chunk_tasks(chunks: int) -> int:
    """Into how many tasks chunks are dealt: about eight each, whatever the session's number of shuffle partitions."""
    return max(48, math.ceil(chunks / 8))


def by_id_range(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, np.ndarray, int]:
    """(__chunk, __id, __text) with chunks of at most about chunk_bytes of text, or one document; the range of each chunk; all bytes.

    Chunk numbers rise with the ids, null ids last. Bounds are laid by cumulated bytes of the
    ids in their order, so a chunk takes at most chunk_bytes and one id more. An id, or all null
    ids, with more than that in several rows is a range of its own: its rows are written in the
    order of their texts and cut into several chunks. Chunks of one range are of one id; others
    hold whole ids. The driver holds two numbers for each chunk.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias(_ID), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(_TEXT))
    weight = F.octet_length(_TEXT).cast("long")
    each = written(texts.groupBy(_ID).agg(F.sum(weight).alias("__bytes"), F.count(F.lit(1)).alias("__rows")), "ids").withColumn("__weight", F.col("__bytes") + ROW_BYTES * F.col("__rows"))
    n_ids, n_bytes, total = (int(x or 0) for x in each.agg(F.count(F.lit(1)), F.sum("__bytes"), F.sum("__weight")).first())
    most = max(1, min(chunk_bytes, -(-total // 48)))
    split = (F.col("__rows") > 1) & (F.col("__weight") > most)
    heavy = sorted((r[0], r[1]) for r in each.filter(split).select(_ID, "__weight").collect())
    apart = np.array([i for i, _ in heavy], np.int64)
    shared = _shares(each.filter(~split).select(_ID, "__weight"), [_ID], [_ID], max(1, n_ids // SORTED_IDS), most)
    ends = [r[0] for r in shared.groupBy("__part", "__share", _place(apart)(F.col(_ID)).alias("__between")).agg(F.max(_ID)).select(f"max({_ID})").collect()]
    bounds = np.unique(np.concatenate([np.array(ends, np.int64), apart]))
    if not heavy:
        return texts.withColumn(_CHUNK, _place(bounds)(F.col(_ID))).select(_CHUNK, _ID, _TEXT), np.arange(len(bounds)), n_bytes

    start = F.substring(F.encode(_TEXT, "UTF-8"), 1, 256)
    rest = F.when(F.octet_length(_TEXT) <= 256, F.rand(1)).otherwise(2.0)  # equal rows in any order, longer texts after them
    is_heavy = _among(apart)(F.col(_ID))
    rows = texts.filter(is_heavy).withColumn("__weight", weight + ROW_BYTES).withColumn("__start", start).withColumn("__rest", rest)
    rows = _shares(rows, [_ID, "__start", "__rest"], [_ID, _TEXT], parts(sum(w for _, w in heavy), SORTED_BYTES, 12), most)
    rows = written(rows.select(_ID, _TEXT, "__part", "__share"), "heavy")
    found = sorted(tuple(r) for r in rows.select(_ID, "__part", "__share").distinct().collect())
    count = np.ones(len(bounds), np.int64)
    for i, n in zip(*np.unique(np.array([f[0] for f in found], np.int64), return_counts=True), strict=True):
        count[np.searchsorted(bounds, i)] = n
    first = np.cumsum(count) - count
    numbers, seen = [], dict(zip(apart.tolist(), first[np.searchsorted(bounds, apart)].tolist(), strict=True))
    for i, part, share in found:
        numbers.append((i, part, share, seen[i]))
        seen[i] += 1
    numbers = docs.sparkSession.createDataFrame(numbers, f"{_ID} bigint, __part int, __share bigint, {_CHUNK} int")
    rows = rows.join(F.broadcast(numbers), [_ID, "__part", "__share"]).select(_CHUNK, _ID, _TEXT)  # a row for each chunk
    light = texts.filter(~is_heavy).withColumn(_CHUNK, _place(bounds, first)(F.col(_ID))).select(_CHUNK, _ID, _TEXT)
    return light.unionByName(rows), np.repeat(np.arange(len(bounds)), count), n_bytes


def _shares(df: DataFrame, dealt_by: list[str], order: list[str], ranges: int, most: int) -> DataFrame:
    """df, dealt to ranges, with __part (the range) and __share: how often `most` goes into the __weight of the range's rows before. Only Spark's own sort, which spills, holds the rows."""
    before = F.coalesce(F.sum("__weight").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.repartitionByRange(ranges, *dealt_by).withColumn("__part", F.spark_partition_id()).withColumn("__share", F.floor(before / most).cast("long"))


def _place(bounds: np.ndarray, numbers: np.ndarray | None = None):
    @F.arrow_udf(T.IntegerType())
    def chunk(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="left")
        return pa.array((at if numbers is None else numbers[at]).astype(np.int32))

    return chunk


def _among(sorted_: np.ndarray):
    @F.arrow_udf(T.BooleanType())
    def among(ids: pa.Array) -> pa.Array:
        ids = ids.to_numpy(zero_copy_only=False)
        return pa.array(sorted_[np.minimum(np.searchsorted(sorted_, ids), len(sorted_) - 1)] == ids)

    return among


RANGE_ROWS = 200_000  # of a task that numbers rows


def dealt(rows: DataFrame, key: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows, written by ranges of key and order, with the range of each as __part; and a row for each key and range: (key, __part, __base: the key's rows in earlier ranges, __rows, __total: all of the key).

    A key of any number of rows is spread over ranges, for equal rows are told apart by __tie;
    nothing is gathered, and what numbers rows afterwards works on (__part, key).
    """
    tied = written(rows.withColumn("__tie", F.monotonically_increasing_id()), name)
    n = parts(tied.count(), RANGE_ROWS, 24)
    ranged = written(tied.repartitionByRange(n, key, *order, "__tie").withColumn("__part", F.spark_partition_id()), f"{name}-ranges")
    forget(tied)
    counts = ranged.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("__rows").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged, written(counts.select(key, "__part", "__rows", before.alias("__base"), F.sum("__rows").over(of_key).alias("__total")), f"{name}-spans")


# --- bytes and words of a chunk, as numpy arrays -------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept and grown as needed."""
    key = str(int(base))
    if key not in _powers or len(_powers[key]) <= n:
        out = np.full(max(n + 1, 1 << 16), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[key] = out
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit; may write over x."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE ** position over the first i bytes, modulo 2 ** 64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of buf[start:end], whatever their place, from the prefix sums of buf."""
    return mix((sums[end] - sums[start]) * powers(BASE_INV, len(sums))[start])


SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a space after each, and where each begins (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    return buf, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def word_spans(buf: np.ndarray, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with a separator. inner: which bytes belong to words."""
    inner = ~SPACES[buf] if inner is None else inner
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inner]).view(np.int8)))
    return edges[::2], edges[1::2]


def windows(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all n consecutive words that lie in one text (of: the text of each word), and the first word of each."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(of[: count] == of[n - 1 :])
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * BASE + words[i : i + count]
    return mix(out[at]), at


def check_windows(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A second hash, of 16 bits, of the n words from each place on, independent of that of windows."""
    out = np.zeros(len(at), np.uint64)
    mixed = mix(words ^ np.uint64(0xC2B2AE3D27D4EB4F))
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[at + i]
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit words, byte by byte from the highest on: neighbours share high bytes, which then compress."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def first_of(sorted_: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array differ from the one before."""
    out = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=out[1:])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[first_of(x)]


def is_in(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def bucket_slices(sorted_: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted hashes that are dealt to buckets by their high bits."""
    bounds = np.array([(b << 64) // buckets for b in range(buckets)] , dtype=np.uint64)
    cuts = np.append(np.searchsorted(sorted_, bounds), len(sorted_))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), int(cuts[b]), int(cuts[b + 1])


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def id_column(name: str) -> Column:
    return F.when(F.col(_ID) != LAST, F.col(_ID)).alias(name)
