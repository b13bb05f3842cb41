import zlib
from collections import Counter

import numpy as np
from .helpers import ROWS, awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelens.llm import sharding


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 10**6))
def test_matrix_has_exact_sums(sources, shards, seed):
    sizes = sharding.shard_sizes(sum(sources), shards)
    m = np.array(sharding.communication_matrix(sources, sizes, seed))
    assert m.sum(axis=1).tolist() == sources and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(3)
    drawn = [sharding.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(drawn) - 250) < 4 and 10 < np.std(drawn) < 17


def test_counts_slots_and_checksums(spark):
    rows = [(i, f"text {i % 7}") for i in range(1003)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=40).collect()
    by = Counter(r.shard for r in got)
    assert sorted(r.doc_id for r in got) == list(range(1003)) and max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(40))
    for shard, n in by.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)


def test_large_sources_in_cells(spark, monkeypatch):
    """Sources and shards of many cells: every row once, exact sizes, gapless slots, uniform."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    monkeypatch.setattr(sharding, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(i, "t") for i in range(4000)], "doc_id bigint, text string")
    got = sharding.shard_documents(df, shards=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(1000))
    counts = Counter((r.doc_id // 1000, r.shard, r.slot // 500) for r in got)
    assert sum((counts[a, b, c] - 125) ** 2 / 125 for a in range(4) for b in range(4) for c in range(2)) < 61.1


def test_uniform(spark):
    """Neighbours in the input land in all shards alike (chi-squared far below its 0.1 % bound)."""
    df = spark.createDataFrame([(i, "t") for i in range(4000)], "doc_id bigint, text string")
    got = sharding.shard_documents(df, shards=4).collect()
    counts = Counter((r.doc_id // 1000, r.shard) for r in got)
    assert sum((counts[a, b] - 250) ** 2 / 250 for a in range(4) for b in range(4)) < 27.9


def test_awkward_rows_and_order_of_input(spark):
    df = awkward(spark, ROWS)
    first = sorted(map(str, sharding.shard_documents(df, 3).collect()))
    assert first == sorted(map(str, sharding.shard_documents(df.repartition(5), 3).collect())) and len(first) == len(ROWS)
    assert sharding.shard_documents(df.limit(0), 3).count() == 0
    wide = sharding.shuffle_shards(df, 3, ["doc_id", "text"])
    assert set(wide.columns) == set(df.columns) and dict(wide.dtypes)["slot"] == "bigint"


def test_columns_of_any_name(spark):
    names = ["__at", "__source", "__cell", "__before", "__ends", "__n", "__aside_0", "a.b", "shard"]
    df = spark.range(50).select("id", *[(F.col("id") * (i + 2)).alias(n) for i, n in enumerate(names)])
    out = sharding.shuffle_shards(df, 3, ["id", "a.b"])
    assert out.columns == ["id", *names[:-1], "shard", "slot"]
    got = out.collect()
    assert sorted(tuple(r)[:9] for r in got) == [tuple([i] + [i * (k + 2) for k in range(8)]) for i in range(50)]
    assert sorted(Counter(r.shard for r in got).values()) == [16, 17, 17]


def test_documents_travel_and_no_task_holds_a_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = sharding.shard_documents(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "crc32(" in plan.splitlines()[0]  # taken from the text after the exchange
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small partitions are put together
    try:
        sharding.write_shards(sharding.sharded_documents(df, 2), f"{tmp_path}/shards")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = spark.read.parquet(f"{tmp_path}/shards").withColumn("file", F.input_file_name()).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
    assert all(len({r.file for r in got if r.shard == s}) > 1 for s in (0, 1))
