"""Pairs of sets that overlap: an inverted index over each set's rarest elements with filters by size and place, then exact overlaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .numbering import RANGE_ROWS, numbered

CELL_ROWS = 4_096  # sets of one element that meet in one group; elements of one set that are looked up together
LANES = 4  # of 64 bits each, in a set's bitmap


def set_classes(members: DataFrame, id_col: str, element: str) -> DataFrame:
    """(id, class_id) of every set with an element: class_id is the smallest id of the sets that are equal to it.

    Sets are told apart by their size and by sums of their elements' hashes, which tasks add up
    before they travel; no set is gathered.
    """
    members = members.select(F.col(id_col).alias("id"), F.col(element).cast("string").alias("e")).filter("e is not null").distinct()
    half = lambda c, k: F.sum(F.conv(F.substring(F.sha2(c, 256), 15 * k + 1, 15), 16, 10).cast("decimal(28,0)")).alias(f"s{k}")
    each = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[half("e", k) for k in range(2)])
    least = each.groupBy("n", "s0", "s1").agg(F.min("id").alias("class_id"))
    return each.join(least, ["n", "s0", "s1"]).select("id", "class_id")


def class_pairs(members: DataFrame, id_col: str, element: str, least: float) -> DataFrame:
    """set_overlap_pairs between the first sets of each class of equal sets; set_classes has the members."""
    members = written(members.select(id_col, element).distinct(), "members")
    first = set_classes(members, id_col, element).filter("id = class_id").select(F.col("id").alias(id_col))
    return set_overlap_pairs(members.join(first, id_col, "left_semi"), id_col, element, least)


def set_overlap_pairs(members: DataFrame, id_col: str, element: str, least: float, cell_rows: int = CELL_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(left_id, right_id, shared, ratio) with left_id < right_id and shared / size of the larger set >= least.

    Elements are ordered from the rarest to the most frequent. Two such sets share an element
    among the first n - ceil(least * n) + 1 of each; their first common one also leaves enough
    elements behind it in both. Only those elements are joined, and only where size and place
    allow the overlap, and only where the sets' bitmaps do: two sets differ in at least as many
    elements as their bitmaps in bits. That is tested within the join, so pairs that can't overlap
    enough are no rows. An element of many sets is split into cells of sets of like size, and
    cells meet in pairs whose sizes can go together, so no task holds more of it than two
    cells. Shared elements are then counted by rows of the smaller set. No set is gathered,
    rows are numbered within sets and elements by numbering.numbered. Null ids and elements
    are left out; repeated rows count once.
    """
    members = members.select(F.col(id_col).alias("id"), F.col(element).alias("e")).filter("id is not null and e is not null").distinct()
    members = written(members, "members")
    rows = members.count()
    often = numbered(members, "e", ["id"], "nth", "often", range_rows, rows).drop("nth")
    held = written(numbered(often, "id", ["often", "e"], "pos", "n", range_rows, rows).drop("often"), "held")
    need = F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9))
    index = numbered(held.filter(F.col("pos") <= F.col("n") - need + 1), "e", ["n", "id"], "nth", "sets", range_rows)
    index = index.filter("sets > 1").join(_bitmaps(members), "id")
    index = written(index.withColumn("cell", F.floor((F.col("nth") - 1) / cell_rows)).drop("nth", "sets"), "cells")

    # the elements of each pair's smaller set, looked up in the other one
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("small_n") - 1) / cell_rows))).alias("block")
    tasks = max(4 * members.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / range_rows))
    asked = _candidates(index, least, tasks).select("small", "large", "large_n", blocks)
    small = held.select(F.col("id").alias("small"), F.floor((F.col("pos") - 1) / cell_rows).alias("block"), "e")
    each = asked.join(small, ["small", "block"]).select("small", "large", "large_n", "e")
    found = each.join(members.select(F.col("id").alias("large"), "e"), ["large", "e"], "left_semi")
    shared = found.groupBy("small", "large", "large_n").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.select(F.least("small", "large").alias("left_id"), F.greatest("small", "large").alias("right_id"), "shared", (F.col("shared") / F.col("large_n")).alias("ratio"))
    return out.filter(F.col("ratio") >= least)


def _bitmaps(members: DataFrame) -> DataFrame:
    """(id, bits0, ...): each set's elements as bits of LANES numbers; elements may share a bit."""
    bit = members.select("id", F.pmod(F.xxhash64("e"), F.lit(64 * LANES)).cast("int").alias("bit"))
    lane = lambda k: F.bit_or(F.expr(f"if(bit div 64 = {k}, shiftleft(1L, bit % 64), 0L)")).alias(f"bits{k}")
    return bit.groupBy("id").agg(*[lane(k) for k in range(LANES)])


def _candidates(index: DataFrame, least: float, tasks: int) -> DataFrame:
    """(small, large, small_n, large_n): pairs of sets that share an element of the index where sizes, places and bitmaps allow the overlap.

    The join's work is its pairs, not its bytes: it gets a number of tasks, which isn't coalesced.
    """
    cells = index.groupBy("e", "cell").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = cells.select("e", F.col("cell").alias("a"), "high"), cells.select("e", F.col("cell").alias("b"), "low")
    # cells ascend by size: b's least may be above a's greatest, but not by more than the ratio
    meets = a.join(b, "e").filter((F.col("a") <= F.col("b")) & (F.col("high") >= F.col("low") * F.lit(least) - F.lit(1e-9))).select("e", "a", "b")
    side = lambda s, c: index.select("e", F.col("cell").alias(c), *[F.col(x).alias(f"{s}_{x}") for x in ("id", "n", "pos", *(f"bits{k}" for k in range(LANES)))])
    both = side("small", "a").join(meets, ["e", "a"]).repartition(tasks, "e", "b").join(side("large", "b").repartition(tasks, "e", "b"), ["e", "b"])
    # of equal sizes the smaller id is "small", so that each pair is met in one direction only
    below = F.struct(F.col("small_n"), F.col("small_id")) < F.struct(F.col("large_n"), F.col("large_id"))
    need = F.ceil(F.col("large_n") * F.lit(least) - F.lit(1e-9))
    left = 1 + F.least(F.col("small_n") - F.col("small_pos"), F.col("large_n") - F.col("large_pos"))
    apart = sum((F.bit_count(F.col(f"small_bits{k}").bitwiseXOR(F.col(f"large_bits{k}"))) for k in range(LANES)), F.lit(0))
    both = both.filter(below & (F.col("small_n") >= need) & (left >= need) & (F.col("small_n") + F.col("large_n") - apart >= 2 * need))
    return both.select(F.col("small_id").alias("small"), F.col("large_id").alias("large"), "small_n", "large_n").distinct()
