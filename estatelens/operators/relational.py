"""Joins, checks and groupings over keyed tables: orphans, unmatched keys, conflicts of labels, unused columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(nodes: DataFrame, edges: DataFrame, node: str, source: str) -> DataFrame:
    """Nodes that no edge starts from."""
    return nodes.join(edges.select(F.col(source).alias(node)).distinct(), node, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right doesn't hold: must be empty where every key has to match."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exactly_one(df: DataFrame, condition: Column):
    """The one row that meets a condition; KeyError if there is none or more."""
    found = df.filter(condition).take(2)
    if len(found) != 1:
        raise KeyError(f"{len(found) or 'no'} rows where one is expected")
    return found[0]


def conflicting_pairs(items: DataFrame, id_col: str, label: str, definition: str) -> DataFrame:
    """(label, left_id, right_id) of items with one label and different definitions, left_id < right_id."""
    items = items.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(definition).alias("d")).filter("label is not null and label <> ''")
    mixed = items.groupBy("label").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi").select("label")
    items = items.join(mixed, "label")
    pairs = items.alias("l").join(items.alias("r"), "label").filter("l.id < r.id and l.d <> r.d")
    return pairs.select("label", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))


def conflicting_labels(items: DataFrame, label: str, definition: str) -> DataFrame:
    """Labels with more than one definition, with their number and that of the conflicting pairs of items; no pair is formed."""
    each = items.filter(F.col(label).isNotNull()).groupBy(label, definition).agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy(label).agg(F.count(F.lit(1)).alias("definitions"), F.sum("n").alias("items"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    pairs = ((F.col("items") * F.col("items") - F.col("squares")) / 2).cast("long")
    return total.filter("definitions > 1").select(label, "definitions", "items", pairs.alias("pairs"))


def conflicting_items(items: DataFrame, id_col: str, label: str, definition: str) -> DataFrame:
    """(label, id, definition, conflicts) of every item whose label has more than one definition; conflicts: how many items of the label are defined otherwise.

    All conflicting pairs in a row for each item: two items conflict if they share the label
    and not the definition. ids occur once for each label.
    """
    items = items.select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.col(definition).alias("definition")).filter("label is not null and label <> '' and definition is not null")
    each = items.groupBy("label", "definition").agg(F.count(F.lit(1)).alias("same"))
    total = each.groupBy("label").agg(F.count(F.lit(1)).alias("definitions"), F.sum("same").alias("items")).filter("definitions > 1")
    each = each.join(total, "label").select("label", "definition", (F.col("items") - F.col("same")).alias("conflicts"))
    return items.join(each, ["label", "definition"]).select("label", "id", "definition", "conflicts")


def conflicting_definitions(items: DataFrame, id_col: str, label: str, definition: str) -> DataFrame:
    """(label, definition, items, first_id, conflicts) of every definition of a label that has more than one.

    All conflicting pairs, grouped: any two rows of a label stand for the pairs between their
    items; conflicts: how many items are defined otherwise. conflicting_items has the members.
    """
    items = items.select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.col(definition).alias("definition")).filter("label is not null and label <> '' and definition is not null")
    each = items.groupBy("label", "definition").agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_id"))
    total = each.groupBy("label").agg(F.count(F.lit(1)).alias("definitions"), F.sum("items").alias("all")).filter("definitions > 1")
    return each.join(total, "label").select("label", "definition", "items", "first_id", (F.col("all") - F.col("items")).alias("conflicts"))


def first_match(left: DataFrame, right: DataFrame, key: str, equal: list[tuple[str, str]], order: str) -> DataFrame:
    """left with the first row of right (nulls last) that meets one of several equalities (left column, right column), the earlier ones first.

    A join for each equality and a choice, not an OR join. right is cut down to the first row of
    each value before it is joined, so a row of left meets one row at most for each equality.
    """
    out = None
    place = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("place"))
    for rank, (own, its) in enumerate(equal):
        first = right.filter(F.col(its).isNotNull()).groupBy(F.col(its).alias("__value")).agg(F.min_by(F.struct(*right.columns), place(order)).alias("row"))
        met = left.join(first, left[own] == F.col("__value")).select(key, F.struct(F.lit(rank).alias("rank"), "row").alias("m"))
        out = met if out is None else out.unionByName(met)
    best = out.groupBy(key).agg(F.min_by("m", F.struct("m.rank", place(f"m.row.{order}"))).alias("m")).select(key, F.col("m.row").alias("match"))
    return left.join(best, key, "left")


def unused_columns(columns: DataFrame, edges: DataFrame, parent: str, column: str, name: str, source: str, least: int) -> DataFrame:
    """(parent, unused, names) of parents with `least` or more columns that nothing reads."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    unread = columns.join(edges.select(F.col(source).alias(column)).distinct(), column, "left_anti")
    out = unread.groupBy(parent).agg(F.count(F.lit(1)).alias("unused"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))
    return out.filter(F.col("unused") >= least)


def fan_out(assets: DataFrame, targets: DataFrame, asset: str, target_of: str, target: str, finding: str) -> DataFrame:
    """(target, findings): the findings of each target, whether they name it or the asset that it belongs to."""
    direct = assets.join(targets.select(F.col(target).alias(asset)).distinct(), asset).select(F.col(asset).alias(target), finding)
    through = assets.join(targets.select(F.col(target_of).alias(asset), target), asset).select(target, finding)
    return direct.union(through).groupBy(target).agg(F.array_sort(F.collect_set(finding)).alias("findings"))
