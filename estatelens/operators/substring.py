"""Texts that occur within texts: an inverted index of pieces proposes pairs, the texts decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1, 2, 4, 8)  # characters of the pieces


def _pieces(text: Column, size: int) -> Column:
    """All substrings of that many characters, each once; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def containment_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle_id, hay_id) of needles (needle_id, grp, text) that occur in hays (hay_id, grp, text) of their group, each pair once.

    A needle looks for the hays that hold its rarest piece: of eight characters, or, if it is
    shorter, of the greatest of four, two and one that it has. Then the texts are compared.
    An empty needle occurs in every text of its group. Null texts and groups pair with nothing.
    """
    needles = needles.filter("needle_id is not null and grp is not null and text is not null").select("needle_id", "grp", "text").distinct()
    hays = hays.filter("hay_id is not null and grp is not null and text is not null").select("hay_id", "grp", "text").distinct()
    own = F.array(F.lit(""))
    for size in SIZES:
        own = F.when(F.length("text") >= size, _pieces(F.col("text"), size)).otherwise(own)
    asked = needles.select("*", F.explode(own).alias("piece"))
    every = F.concat(F.array(F.lit("")), *[_pieces(F.col("text"), size) for size in SIZES])
    held = hays.select("hay_id", "grp", F.explode(every).alias("piece"), F.col("text").alias("hay"))
    counts = held.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("often"))
    # a piece that no hay holds counts as the rarest: its needle then meets nothing
    rated = asked.join(counts, ["grp", "piece"], "left").fillna(0, ["often"])
    best = rated.groupBy("needle_id", "grp", "text").agg(F.min_by("piece", F.struct("often", "piece")).alias("piece"))
    both = best.join(held, ["grp", "piece"]).filter(F.contains("hay", "text"))
    return both.select("needle_id", "hay_id").distinct()
