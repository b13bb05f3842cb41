"""Connected components by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Edges may repeat and go either way. The number of rounds grows with the logarithm of the
    graph's size; no neighbourhood is gathered anywhere.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written(links, "links")
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        links, done = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"), links
        forget(done)
        state, before = _state(links), state
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())


def _state(links: DataFrame) -> tuple:
    half = lambda c: F.sum(F.shiftrightunsigned(F.xxhash64(*c), 24))
    return tuple(links.agg(F.count(F.lit(1)), half(["u", "v"]), half(["v", "u"])).first())
