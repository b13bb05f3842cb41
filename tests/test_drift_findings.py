"""Merging of drifted pairs: evidence stays distinct and in order, and a metric of many pairs is done in time."""

import time

from pyspark.sql import functions as F

from estatelens.functions import arrays
from estatelens.plans import definitions
from estatelens.schemas import EVIDENCE


def test_a_metric_of_many_pairs(spark):
    """Two pairs each share a pointer. Comparing each pointer with all before it would take minutes."""
    n = 20_000
    evidence = F.array(F.struct(F.lit("table").alias("source"), F.lit("tables").alias("uri"), (F.col("n") % (n // 2)).cast("string").alias("locator"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("excerpt")))
    judged = spark.range(n).select(F.col("id").alias("n")).select(
        F.concat(F.lit("c"), F.col("n").cast("string")).alias("id"), F.lit("m").alias("metric_name"), F.lit("same_metric_label").alias("match_kind"), F.lit("drifted").alias("verdict"), F.lit("tile.first").alias("left_asset_id"),
        F.concat(F.lit("tile."), F.col("n").cast("string")).alias("right_asset_id"), evidence.alias("evidence"), F.lit("a").alias("left_sql_quote"), F.lit("b").alias("right_sql_quote"), F.lit(0.5).alias("confidence"),
    )
    began = time.time()
    (got,) = definitions.drift_findings(judged).collect()
    assert time.time() - began < 60
    want = []
    for i in sorted(range(n), key=lambda i: f"c{i}"):
        want += [("table", "tables", str(i % (n // 2)), None, None)]
        want += [("dashboard_metadata", f"semantic://c{i}/{side}", f"candidate=c{i}/side={side}", None, quote) for side, quote in (("left", "a"), ("right", "b"))]
    assert [tuple(e) for e in got.evidence] == list(dict.fromkeys(want))
    assert got.asset_ids == sorted(["tile.first", *[f"tile.{i}" for i in range(n)]])


def test_distinct_structs_are_those_of_array_distinct(spark):
    a, b, c, d = ("s", "u", "1", None, None), ("s", "u", None, "1", None), ("s", "u", None, None, "1"), (None,) * 5
    cases = [[b, a, b, c, a, d, d, c], [a], [a, a, a], [], None, [None, a, None, b, a], [d, None, d], [c, b, a]]
    rows = spark.createDataFrame(list(enumerate(cases)), f"i int, e array<{EVIDENCE}>")
    got = rows.select("i", arrays.distinct_structs(F.col("e")).alias("got"), F.array_distinct("e").alias("want"))
    assert [r.got for r in got.orderBy("i").collect()] == [r.want for r in got.orderBy("i").collect()]
    assert got.schema["got"].dataType.simpleString() == got.schema["want"].dataType.simpleString()
