"""Staleness of assets on a stream: the last use of each key as state, and a timer that reports the key once it hasn't been used for so many days.

Rows of one micro-batch are combined to the newest of each key within each task before the shuffle, so
a hot key sends a row for each task. Keys are dealt to BUCKETS by their hash: state in RocksDB is one
packed value for each bucket, with a timer for the next of its keys, since calls of state and timers
for each key take most of the time where keys are many.

Defined results: rows without a time, or with a null in a key, count for nothing. A row older than the
watermark (the newest time less `late`) is dropped by Spark, as the log's contract allows; among the
rows that aren't, order doesn't matter. A key is stale at the watermark if its last use is `days` or
more before it; a key that is used again is withdrawn by a notice of its own.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch

DAY_US = 86_400_000_000
BUCKETS = 4096  # kept state holds for this number only
HELD_ROWS = 400_000  # newest rows that a task holds before it sends them on
NAN = float("nan")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Staleness(StatefulProcessor):
    def __init__(self, keys: list[str], days: int):
        self.keys, self.span_us = keys, days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("last_uses", "timer bigint, uses binary")

    def _timer(self, at_us: int) -> int:
        """The first watermark, in milliseconds, at which a key is stale; a timer fires once the watermark has reached it."""
        return -(-(at_us + self.span_us) // 1000)

    def _notice(self, key, at_us: int, is_stale: bool) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), at_us=at_us, is_stale=is_stale)

    def _read(self) -> tuple[int | None, dict]:
        """The bucket's timer, and (last use, reported) of each of its keys."""
        held = self.held.get()
        return (None, {}) if held is None else (held[0], {_same(k): v for k, v in pickle.loads(bytes(held[1])).items()})

    def _write(self, timer: int | None, uses: dict, fired: bool = False) -> None:
        """Keeps the uses, and a timer for the first key that isn't reported; timer: the one so far, which Spark deletes itself once it has fired."""
        least = min((at_us for at_us, reported in uses.values() if not reported), default=None)
        due = None if least is None else self._timer(least)
        if due != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.held.update((due, pickle.dumps(uses, protocol=5)))

    def handleInputRows(self, key, rows, timerValues):
        timer, uses = self._read()
        back = {}
        for r in rows:
            k, at_us = _same(r[c] for c in self.keys), r["at_us"]
            held = uses.get(k)
            if held is None or held[0] < at_us:
                if held is not None and held[1] or k in back:
                    back[k] = at_us
                uses[k] = (at_us, False)
        self._write(timer, uses)
        for k, at_us in back.items():
            yield self._notice(k, at_us, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        timer, uses = self._read()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = [(k, at_us) for k, (at_us, reported) in uses.items() if not reported and self._timer(at_us) <= now]
        uses.update({k: (at_us, True) for k, at_us in due})
        self._write(timer, uses, fired=True)
        for k, at_us in due:
            yield self._notice(k, at_us, True)


def _same(key) -> tuple:
    """A key whose NaNs are one object, so that equal keys are found."""
    return tuple(NAN if v != v else v for v in key)


def newest_rows(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """keys and ts: the newest row of each key within each task, or within HELD_ROWS rows of many keys."""
    log = log.filter(F.forall(F.array(*[F.col(c).isNotNull() for c in [*keys, ts]]), lambda x: x)).select(*keys, F.col(ts).cast("timestamp").alias(ts))

    def newest(tables):
        return pa.concat_tables(tables).group_by(keys).aggregate([(ts, "max")]).select([*keys, f"{ts}_max"]).rename_columns([*keys, ts])

    def combine(batches):
        held = []
        for b in batches:
            held.append(newest([pa.Table.from_batches([b])]))
            if sum(t.num_rows for t in held) >= HELD_ROWS:
                held = [newest(held)]
                if held[0].num_rows >= HELD_ROWS // 2:  # too many keys to wait for more rows of theirs
                    yield from held.pop().to_batches(max_chunksize=10_000)
        if held:
            yield from newest(held).to_batches(max_chunksize=10_000)

    return log.mapInArrow(combine, log.schema)


def stale_notices(log: DataFrame, keys: list[str], ts: str, days: int, late: str) -> DataFrame:
    """keys, last_used and is_stale: a notice for each key that becomes stale, or is used again after that. For a streaming log."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    rows = newest_rows(log, keys, ts).withColumn("at_us", F.unix_micros(ts)).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).withWatermark(ts, late)
    schema = ", ".join(f"`{c}` {log.schema[c].dataType.simpleString()}" for c in keys) + ", at_us bigint, is_stale boolean"
    notices = rows.groupBy("__bucket").transformWithState(_Staleness(keys, days), schema, "Append", "EventTime")
    return notices.select(*keys, F.timestamp_micros("at_us").alias("last_used"), "is_stale")


def currently_stale(notices: DataFrame, keys: list[str]) -> DataFrame:
    """keys and last_used of the keys whose newest notice says that they are stale."""
    newest = notices.groupBy(*keys).agg(F.max(F.struct("last_used", "is_stale")).alias("n"))
    return newest.filter("n.is_stale").select(*keys, "n.last_used")


def replay(spark: SparkSession, log: DataFrame, keys: list[str], ts: str, days: int, late: str, path: str | None = None) -> DataFrame:
    """currently_stale once a streaming log has been read to its present end. With a path, notices and state are kept there, and a later call goes on where this one stopped."""
    path = path or scratch(spark, "stale")
    notices = stale_notices(log, keys, ts, days, late)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = notices.writeStream.format("parquet").outputMode("append").option("path", f"{path}/notices").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return currently_stale(spark.read.schema(notices.schema).parquet(f"{path}/notices"), keys)
