import numpy as np
import pytest

from estatelens.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        d = sorted((int(((np.array(v) > 0) != (np.array(w) > 0)).sum()), 2**63 if i is None else i) for i, w in rows)
        out += [(q, rank, None if i == 2**63 else i, dist) for rank, (dist, i) in enumerate(d[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 20])
def test_equals_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(6, bits))
    rows = [(i, (centres[i % 6] + rng.normal(size=bits) * (0.2 if i % 2 else 1.5)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # many copies: ties go to the smaller id
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, topk.search_embeddings(df, k=7, every=50).collect()), key=str)
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0], 7)


def test_large_index_has_wide_segments():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (20_000, 8), dtype=np.uint8)
    index = topk.MultiIndex(codes, np.arange(20_000))
    assert index.bits == 16
    for q in codes[:5]:
        dist, ids = index.search(q, 10)
        d = np.bitwise_count(codes ^ q).sum(axis=1)
        order = np.lexsort((np.arange(20_000), d))[:10]
        assert ids.tolist() == order.tolist() and dist.tolist() == d[order].tolist()


def test_shards_meet_blocks_of_queries(spark, monkeypatch):
    """Several shards, blocks and tasks for each shard."""
    monkeypatch.setattr(topk, "SHARD_CODES", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(topk, "BLOCKS_A_TASK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(600)]
    got = topk.search_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=5, every=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [r for r in rows if r[0] % 4 == 0], 5)


def test_queries_of_one_id_have_a_list_each(spark):
    rows = [(100, [1.0, 1.0, 1.0]), (100, [-1.0, -1.0, -1.0]), (100, [-2.0, -1.0, -3.0]), (3, [1.0, 1.0, -1.0])]
    got = sorted(map(tuple, topk.search_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=2).collect()))
    assert got == [(100, 1, 100, 0), (100, 1, 100, 0), (100, 2, 3, 1), (100, 2, 100, 0)]


def test_awkward_rows(spark):
    rows = [(0, [1.0, -1.0]), (100, None), (200, [1.0, None]), (300, []), (None, [1.0, -1.0]), (7, [-1.0, -1.0]), (7, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as id", "1 as shard", "2 as rank")
    got = sorted(map(tuple, topk.search_embeddings(df, k=10).collect()), key=str)
    assert got == sorted([(0, 1, 0, 0), (0, 2, None, 0), (0, 3, 7, 1), (0, 4, 7, 1)], key=str)
    assert topk.search_embeddings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        topk.search_embeddings(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<double>"))
