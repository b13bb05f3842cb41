"""Reachability by interval labels: what lies below a node is a look-up, no closure is stored."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, written
from . import graph
from .numbering import numbered

BLOCK = 1_024  # places that meet an interval in one group


@dataclass(frozen=True)
class Reach:
    """Labels of a graph, as tables.

    members: (node, component, cyclic), nodes with their strong component and whether it has a cycle.
    places: (component, at), components numbered from 0, each before those of its subtree.
    intervals: (component, low, high), the places that it reaches, its own included; intervals of a component don't overlap.
    acyclic: each node is its own component, and none has a cycle.
    """

    members: DataFrame
    places: DataFrame
    intervals: DataFrame
    acyclic: bool = False

    def below(self, start: DataFrame) -> DataFrame:
        """(node, reached): what each `node` of start reaches by one edge or more, itself only on a cycle; unknown nodes reach nothing."""
        asked = start.select("node").distinct().join(self.members, "node")
        blocks = F.explode(F.sequence(_block(F.col("low")), _block(F.col("high")))).alias("block")
        spans = asked.join(self.intervals, "component").select("node", "component", "cyclic", "low", "high", blocks)
        places = self.places.select(F.col("component").alias("found"), "at", _block(F.col("at")).alias("block"))
        hit = spans.join(places, "block").filter(F.col("at").between(F.col("low"), F.col("high")) & ((F.col("found") != F.col("component")) | F.col("cyclic")))
        own = self.members.select(F.col("node").alias("reached"), F.col("component").alias("found"))
        return hit.select("node", "found").join(own, "found").select("node", "reached")

    def reaches(self, pairs: DataFrame) -> DataFrame:
        """The rows of pairs (src, dst, ...) whose src reaches dst by one edge or more."""
        own = lambda e: self.members.select(F.col("node").alias(e), F.col("component").alias(f"__{e}"), "cyclic")
        # a node has one place, and its intervals lie apart: no pair is found twice
        at, spans = self.places.withColumnRenamed("component", "__dst"), self.intervals.withColumnRenamed("component", "__src")
        if self.acyclic:
            at, spans = at.withColumn("dst", F.col("__dst")), spans.select("*", F.col("__src").alias("src"), F.lit(False).alias("cyclic"))
        else:
            at, spans = at.join(own("dst").drop("cyclic"), "__dst"), spans.join(own("src"), "__src")
        # often few nodes are asked about many others; as a written table they are known to be few
        spans = written(spans.join(pairs.select("src").distinct(), "src", "left_semi"), "asked")
        within = F.col("at").between(F.col("low"), F.col("high")) & ((F.col("__src") != F.col("__dst")) | F.col("cyclic"))
        return pairs.join(spans, "src").join(at, "dst").filter(within).select(*pairs.columns)


def _block(place: Column) -> Column:
    return F.floor(place / BLOCK)


def reach_labels(edges: DataFrame) -> Reach:
    """Labels of the graph of edges (src, dst); cycles are allowed, edges with a null end are left out, repeated ones count once.

    Strong components become one node each. A component below others hangs, in a forest, under
    the least of those one level above it, and its subtree is an interval of the forest's order
    from above. What edges outside the forest lead to is passed up, unless the receiver's own
    interval holds it. So the labels of a forest are one row for each node; in the worst case (a dense
    graph) they grow with the pairs of nodes and targets of such edges. Rounds grow with depth.
    """
    edges = written(edges.select("src", "dst").filter("src is not null and dst is not null"), "edges")
    nodes = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    rounds, dag = graph.peeled(nodes, edges)
    acyclic = sum(t.count() for t in rounds) == nodes.count()
    if acyclic:
        members = nodes.select("node", F.col("node").alias("component"), F.lit(False).alias("cyclic"))
    else:  # cycles are among the nodes that no round has freed
        freed = reduce(DataFrame.union, [t.select(F.col("node").alias("src")) for t in rounds], nodes.select(F.col("node").alias("src")).limit(0))
        strong = graph.strong_components(dag.select("src", "dst").join(freed, "src", "left_anti")).withColumn("cyclic", F.lit(True))
        members = written(nodes.join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")), "members")
        end = lambda e: members.select(F.col("node").alias(e), F.col("component").alias(f"{e}_c"))
        ends = dag.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").filter("src_c <> dst_c")
        rounds, dag = graph.peeled(members.select(F.col("component").alias("node")).distinct(), ends.select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")))
    if not rounds:
        none = members.select("component", F.lit(0).cast("long").alias("low"))
        return Reach(members, none.withColumnRenamed("low", "at"), none.withColumn("high", F.col("low")), acyclic)

    below, sized = None, []  # a level needs the sizes of the next one only
    for n in range(len(rounds) - 1, -1, -1):
        here = rounds[n].withColumn("level", F.lit(n))
        if below is None:
            below = here.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under"))
            below = written(here.join(sums, "node", "left").select("node", "parent", "level", (1 + F.coalesce("under", F.lit(0))).cast("long").alias("size")), "sizes")
        sized.append(below)
    ordered = _by_level(numbered(reduce(DataFrame.union, sized), "parent", ["node"], "upto", "all", weight="size").drop("all"))
    above, spans = None, []
    for n in range(len(rounds)):
        here = ordered.filter(F.col("level") == n).withColumn("first", F.col("upto") - F.col("size"))
        if above is None:
            here = here.withColumn("low", F.col("first"))
        else:
            here = here.join(above.select(F.col("node").alias("parent"), F.col("low").alias("top")), "parent").withColumn("low", F.col("top") + 1 + F.col("first"))
        above = written(here.select("node", "low", (F.col("low") + F.col("size") - 1).alias("high")), "spans")
        spans.append(above)
    spans = reduce(DataFrame.union, spans)
    places = spans.select(F.col("node").alias("component"), F.col("low").alias("at"))

    own = spans.select("node", F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    outside = lambda found: found.join(own, "node").filter("low < own_low or high > own_high").select("node", "low", "high").distinct()
    kept = reduce(DataFrame.union, [t.select(F.col("parent").alias("src"), F.col("node").alias("dst")) for t in rounds])
    # an edge that alone leads to its end is in the forest
    beside = written(dag.filter("waits > 1").select("src", "dst").join(kept, ["src", "dst"], "left_anti"), "beside")
    if beside.isEmpty():
        return Reach(members, places, spans.withColumnRenamed("node", "component"), acyclic)
    new = beside.join(spans.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "low", "high")
    new, found = written(outside(new), "passed"), []
    while not new.isEmpty():
        found.append(new)
        step = dag.join(new.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "low", "high")
        new = written(outside(step).join(reduce(DataFrame.union, found), ["node", "low", "high"], "left_anti"), "passed")
    every = reduce(DataFrame.union, found, spans)
    # subtrees lie within one another or apart: of the former the widest stays
    before = Window.partitionBy("node").orderBy("low", F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    widest = every.withColumn("reach", F.max("high").over(before)).filter("reach is null or high > reach")
    intervals = written(widest.select(F.col("node").alias("component"), "low", "high"), "intervals")
    return Reach(members, places, intervals, acyclic)


def _by_level(df: DataFrame) -> DataFrame:
    """df, written in a folder for each level, so that a round reads its own only."""
    path = scratch(df.sparkSession, "by-level")
    df.write.partitionBy("level").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
