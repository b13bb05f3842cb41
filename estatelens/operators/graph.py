"""Directed graphs as edge tables: closure, levels, cycles, taint. Loops run once for each level of depth; each step is a written table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


class CycleError(ValueError):
    """The graph has a cycle; `cycle` is a simple one, its nodes in order, and the message shows it. `edges` is the table of all edges on or below one."""

    def __init__(self, edges: DataFrame):
        self.edges = edges
        self.cycle = one_cycle(edges)
        super().__init__("cycle: " + " -> ".join(map(str, [*self.cycle, self.cycle[0]])))


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst): all pairs joined by a path of one edge or more; only from the `node`s of start, if given. Cycles are allowed.

    Without start the result can have the square of the nodes' number of rows; give the nodes
    that are asked for wherever they are known. Each round writes its new pairs only.
    """
    edges = edges.select("src", "dst")
    new = edges if start is None else edges.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    new = written(new.distinct())
    edges = written(edges.distinct()) if start is None else edges
    found = [new]
    while not new.isEmpty():
        step = new.alias("p").join(edges.alias("e"), F.col("p.dst") == F.col("e.src")).select("p.src", "e.dst").distinct()
        new = written(step.join(reduce(DataFrame.union, found), ["src", "dst"], "left_anti"))
        found.append(new)
    return reduce(DataFrame.union, found)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest path that leads to each node; CycleError if there is a cycle."""
    nodes = written(nodes.select("node").distinct())
    rounds, edges = peeled(nodes, edges)
    none = nodes.select("node", F.lit(0).alias("level")).limit(0)
    done = reduce(DataFrame.union, [t.select("node", F.lit(n).alias("level")) for n, t in enumerate(rounds)], none)
    if sum(t.count() for t in rounds) < nodes.count():
        waiting = nodes.join(done, "node", "left_anti")
        raise CycleError(edges.join(waiting.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"))
    return done


def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For each level a written table (node, parent) of the distinct nodes whose longest path from above has that length, and the distinct edges (src, dst, waits), written.

    parent: the least of those one level above that lead to the node; waits: how many lead to dst.
    Nodes on or below a cycle are in no level. A round follows the edges of the nodes that the last
    one has freed, and counts what has come in; nodes that nothing has reached are not touched.
    """
    edges = edges.select("src", "dst").distinct()
    waits = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("waits"))
    free = written(nodes.select("node").join(waits.withColumnRenamed("dst", "node"), "node", "left_anti").select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent")))
    edges = written(edges.join(waits, "dst").select("src", "dst", "waits"))
    rounds, partly = [], None
    while not free.isEmpty():
        rounds.append(free)
        got = edges.join(free.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.col("src").alias("parent"), "waits", F.lit(1).cast("long").alias("came"))
        got = got if partly is None else got.union(partly)
        got = written(got.groupBy("node").agg(F.min("parent").alias("parent"), F.first("waits").alias("waits"), F.sum("came").alias("came")))
        partly = got.filter("came < waits").select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), "waits", "came")
        free = got.filter("came = waits").select("node", "parent")
    return rounds, edges


def assert_acyclic(nodes: DataFrame, edges: DataFrame) -> None:
    levels(nodes, edges)


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges, written, without those that lead from a node without edges into it, or to one without edges out of it, until there are none: what is left lies on cycles or between them."""
    left, before = written(edges.select("src", "dst").distinct()), -1
    while (n := left.count()) not in (0, before):
        before = n
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = written(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle; component: a node of it, the same for all that lie on common cycles.

    What trimming leaves is coloured: a node takes the smallest node that leads to it. The nodes
    of one colour from which the colour's own node can be reached are its component; they are
    taken out, and the rest is trimmed and coloured again. Rounds grow with the length of paths
    and the number of components in a row, no pairs are formed.
    """
    left, found = trimmed(edges), []
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    while not left.isEmpty():
        colours = written(left.select("src").union(left.select("dst")).distinct().select(F.col("src").alias("node"), F.col("src").alias("colour"), F.lit(True).alias("new")))
        while not colours.filter("new").isEmpty():
            sent = left.join(colours.filter("new").withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("sent"))
            both = colours.join(sent, "node", "left")
            least = F.least("colour", "sent")
            colours = written(both.select("node", least.alias("colour"), (least < F.col("colour")).alias("new")))
        end = lambda e: colours.select(F.col("node").alias(e), F.col("colour").alias(f"{e}_colour"))
        within = written(left.join(end("src"), "src").join(end("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("component")))
        new = written(colours.filter("node = colour").select("node", F.col("colour").alias("component")))
        reached = [new]
        while not new.isEmpty():
            step = within.join(new.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "component").distinct()
            new = written(step.join(reduce(DataFrame.union, reached), ["node", "component"], "left_anti"))
            reached.append(new)
        members = written(reduce(DataFrame.union, reached))
        found.append(members)
        for e in ("src", "dst"):
            left = left.join(members.select(F.col("node").alias(e)), e, "left_anti")
        left = trimmed(left)
    none = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    members = reduce(DataFrame.union, found, none)
    several = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    alone = members.join(several, "component", "left_anti").select("node", "component").join(loops, "node", "left_semi")
    return members.join(several, "component", "left_semi").select("node", "component").union(alone)


def on_cycle(edges: DataFrame) -> DataFrame:
    """(node) that lie on a cycle."""
    return strong_components(edges).select("node")


def one_cycle(edges: DataFrame) -> list:
    """The nodes of a shortest cycle through the smallest node that lies on one; empty if there is no cycle."""
    members = written(strong_components(edges))
    start = members.agg(F.min("node")).first()[0]
    if start is None:
        return []
    own = members.join(members.filter(F.col("node") == F.lit(start)).select("component"), "component", "left_semi").select("node")
    inner = written(edges.select("src", "dst").distinct().join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    steps, new = [], written(inner.filter(F.col("src") == F.lit(start)).select(F.col("dst").alias("node"), F.col("src").alias("via")))
    while new.filter(F.col("node") == F.lit(start)).isEmpty():
        steps.append(new)
        step = inner.join(new.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        new = written(step.join(reduce(DataFrame.union, steps).select("node"), "node", "left_anti"))
    way, node = [], start
    for table in reversed([*steps, new]):  # one step of the cycle each
        node = table.filter(F.col("node") == F.lit(node)).agg(F.min("via")).first()[0]
        way.append(node)
    return way[::-1]


def tainted(nodes: DataFrame, edges: DataFrame, bad: DataFrame) -> DataFrame:
    """(node) that are bad or can be reached from a bad one."""
    bad = bad.select("node").distinct()
    return bad.union(closure(edges, bad).select(F.col("dst").alias("node"))).distinct().join(nodes.select("node"), "node", "left_semi")


def coverage(nodes: DataFrame, taint: DataFrame) -> DataFrame:
    """One row: total, clean and percent (100 where there is no node)."""
    total = nodes.select("node").distinct().join(taint.withColumn("bad", F.lit(1)), "node", "left")
    out = total.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad").isNull()).alias("clean"))
    share = F.lit(100.0).cast("double") * F.col("clean") / F.col("total")
    return out.withColumn("percent", F.when(F.col("total") == 0, F.lit(100.0)).otherwise(share))


def counts_by_layer(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layer, nodes) and (layers, edges): how many nodes each layer and how many edges each pair of layers has."""
    per_node = nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"))
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("layer").alias(f"{end}_layer"))
    ends = edges.join(of("src"), "src").join(of("dst"), "dst")
    return per_node, ends.groupBy(F.concat_ws("->", "src_layer", "dst_layer").alias("layers")).agg(F.count(F.lit(1)).alias("edges"))
