"""Operators on small tables made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from estatelens import queries
from estatelens.functions import text
from estatelens.operators import graph, overlap, relational, semantic, usage
from estatelens.streaming import usage as stream_usage


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_closure_with_a_cycle(spark):
    got = {tuple(r) for r in graph.closure(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd"}


def test_levels_and_cycles(spark):
    got = dict(map(tuple, graph.levels(nodes(spark, "abcde"), edges(spark, [("a", "b"), ("b", "d"), ("a", "d"), ("c", "d")])).collect()))
    assert got == {"a": 0, "b": 1, "c": 0, "d": 2, "e": 0}
    with pytest.raises(graph.CycleError) as e:
        graph.assert_acyclic(nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]))
    assert {tuple(r) for r in e.value.edges.collect()} == {("a", "b"), ("b", "a"), ("b", "c")} and "a -> b" in str(e.value)


def test_taint_and_coverage(spark):
    n, e = nodes(spark, "abcd"), edges(spark, [("a", "b"), ("b", "c")])
    bad = graph.tainted(n, e, nodes(spark, "b"))
    assert sorted(r[0] for r in bad.collect()) == ["b", "c"] and graph.coverage(n, bad).first().percent == 50
    assert graph.coverage(n.limit(0), bad).first().percent == 100


def test_overlap_counts_sets_once_and_skips_empty(spark):
    rows = [("a", x) for x in "pqrst"] + [("a", "p")] + [("b", x) for x in "pqrsx"] + [("c", x) for x in "pq"] + [("d", None)]
    got = [tuple(r) for r in overlap.set_overlap_pairs(spark.createDataFrame(rows, "i string, e string"), "i", "e", 0.8).collect()]
    assert got == [("a", "b", 4, 0.8)]


def test_usage_bounds_are_inclusive(spark):
    end = dt.datetime(2024, 5, 1)
    rows = [("x", end), ("x", end - dt.timedelta(days=10)), ("x", end - dt.timedelta(days=10, seconds=1)), ("x", end + dt.timedelta(seconds=1)), ("y", end - dt.timedelta(days=120))]
    log = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    assert usage.usage_window(log, ["k"], "ts", end, 10).filter("k = 'x'").first().used == 2
    assert [r.k for r in usage.stale(log, ["k"], "ts", end, 120).collect()] == ["y"]
    with pytest.raises(ValueError):
        usage.usage_window(log, ["k"], "ts", end, 0)


@pytest.mark.parametrize("placed_rows", [7, 1000])
def test_total_order_places_every_row(spark, placed_rows):
    rows = [(None if i % 9 == 0 else i * 37 % 11, i) for i in range(200)]
    got = {r.i: r.place for r in usage.total_order(spark.createDataFrame(rows, "k int, i int"), ["k", "i"], placed_rows).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}


def test_log_places_has_every_event(spark):
    data = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{data}/events.parquet").count()
    got = sorted(r.place for r in queries.QUERIES["log_places"](spark, data).collect())
    assert n > 500 and got == list(range(1, n + 1))


def test_exactly_one(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert relational.exactly_one(df, F.col("x") == 1).x == 1
    for x in (2, 3):
        with pytest.raises(KeyError):
            relational.exactly_one(df, F.col("x") == x)


def test_conflicting_items_hold_all_pairs(spark):
    rows = [("a", i, i // 2) for i in range(7)] + [("b", 1, 5), ("b", 2, 5), ("", 1, 1), ("", 2, 2), (None, 1, 1), (None, 2, 2), ("a", 99, None)]
    items = spark.createDataFrame(rows, "l string, i int, d int")
    got = relational.conflicting_items(items, "i", "l", "d").collect()
    pairs = {(x.label, x.id, y.id) for x in got for y in got if x.label == y.label and x.id < y.id and x.definition != y.definition}
    assert pairs == {tuple(r) for r in relational.conflicting_pairs(items, "i", "l", "d").collect()} and sum(r.conflicts for r in got) == 2 * len(pairs)


def test_same_metric_conflicts_has_every_supplier(spark):
    data = "/root/testdata/sf0.01"
    got = {r.id for r in queries.QUERIES["same_metric_conflicts"](spark, data).select("id").distinct().collect()}
    assert max(got) > 60 and got == {r[0] for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey").distinct().collect()}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.canonical_text(F.lit("  Select\n\tA ")).alias("a"), text.label_name(F.lit("--Total Revenue (net)!")).alias("b"), text.relation_name(F.lit("x"), F.lit(""), F.lit(None), F.lit("y")).alias("c"),
        text.day_windows(F.lit("interval '7 days' interval '30 days' interval '7 days'")).alias("d"), text.percent(F.lit(0.8)).alias("e"), text.after_first_dot(F.lit("model.a.b")).alias("f"),
    ).first()
    assert tuple(row) == ("select a", "total_revenue_net", "x.y", ["7", "30"], "80%", "a.b")


def test_verdicts(spark):
    rows = [("active", "x interval '7 days'", "x interval '30 days'", "p", "q"), ("total_revenue", "s", "t", "sum(a)", "sum(a - refunds)"), ("net_revenue", "amount - refunds", "net_amount", "p", "q"), ("net_revenue", "amount - refunds", "amount - refunds", "p", "q")]
    got = [r.verdict for r in semantic.judged(spark.createDataFrame(rows, "metric_name string, left_sql string, right_sql string, left_primary string, right_primary string")).collect()]
    assert got == ["drifted", "drifted", "equivalent", "equivalent"]


def test_contained(spark, monkeypatch):
    monkeypatch.setattr(semantic, "SHORT_BYTES", 4)
    docs = [(1, "the quick brown fox jumps over"), (2, "a thequick brown foxy jump"), (None, "the quick brown fox jumps over"), (3, None), (4, "abcd  efgh"), (4, "abcd  efgh"), (5, "")]
    items = [(1, "quick brown fox"), (2, "quick brown fox jumps over"), (3, "abc"), (4, "cd  ef"), (5, "own fox"), (6, None), (7, "nowhere in here at all"), (8, "brown foxy jump")]
    got = semantic.contained(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {i: (sum(t in (d or "") for _, d in docs), min((k for k, d in docs if k is not None and t in (d or "")), default=None)) for i, t in items if t}
    assert {r.item_id: (r.hits, r.first_doc) for r in got} == {i: x for i, x in want.items() if x[0]}


def test_stream(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 5)), ("a", dt.datetime(2024, 1, 1, 9)), ("b", dt.datetime(2024, 1, 2, 1)), ("a", dt.datetime(2024, 1, 9, 1))]
    log = spark.createDataFrame(rows, "k string, ts timestamp")
    log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    query = stream_usage.daily_usage(stream, ["k"], "ts").writeStream.format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/cp").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.day.day, r.k, r.used) for r in spark.table("daily").collect()} == {(1, "a", 2), (2, "b", 1), (9, "a", 1)}
    held = spark.createDataFrame([("a", dt.datetime(2024, 1, 5)), ("c", dt.datetime(2023, 1, 1))], "k string, last_used timestamp")
    assert {r.k: r.last_used.day for r in stream_usage.merge_last_used(held, log, ["k"], "ts").collect()} == {"a": 9, "b": 2, "c": 1}


def test_cycles(spark):
    import random

    rnd = random.Random(6)
    frame = lambda pairs: spark.createDataFrame(pairs, "src bigint, dst bigint")
    for n, m in ((14, 18),):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (200, 200), (104, 201)]
        reach = {v: set() for p in pairs for v in p}
        for v in reach:
            todo = [v]
            while todo:
                x = todo.pop()
                for a, b in pairs:
                    if a == x and b not in reach[v]:
                        reach[v].add(b)
                        todo.append(b)
        got = {r.node: r.component for r in graph.strong_components(frame(pairs)).collect()}
        assert set(got) == {v for v in reach if v in reach[v]} == {r.node for r in graph.on_cycle(frame(pairs)).collect()}
        assert all((got[a] == got[b]) == (b in reach[a] and a in reach[b]) for a in got for b in got)
        cycle = graph.one_cycle(frame(pairs))
        assert cycle[0] == min(got) and len(set(cycle)) == len(cycle) and all((a, b) in pairs for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True))
    tree = frame([(1, 2), (1, 3), (3, 4)])
    assert graph.one_cycle(tree) == [] and graph.on_cycle(tree).isEmpty() and graph.one_cycle(tree.limit(0)) == []
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node bigint")
    with pytest.raises(graph.CycleError, match="cycle: 5 -> 6 -> 5") as e:
        graph.levels(nodes, frame([(1, 2), (2, 5), (5, 6), (6, 5), (6, 7)]))
    assert e.value.cycle == [5, 6]
    got = {r.node: r.level for r in graph.levels(nodes, frame([(1, 2), (1, 3), (2, 3), (3, 4), (1, 4), (5, 6)])).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 1, 7: 0}
