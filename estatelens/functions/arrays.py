"""Array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_structs(items: Column) -> Column:
    """array_distinct for arrays of structs: the first of equal ones, in the order given.

    array_distinct compares a struct with all that it has kept, so its time grows with the
    square of their number. Here equal ones become neighbours by sorting; a hash stands in
    front, so that most comparisons are of two numbers, and the struct itself decides.
    """
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), i.alias("i"))))
    firsts = lambda a: F.filter(a, lambda y, i: (i == 0) | ~y["x"].eqNullSafe(F.get(a, i - 1)["x"]))
    kept = F.get(F.transform(F.array(placed), firsts), F.lit(0))  # within an array, a name for what is read twice: it is sorted once
    return F.transform(F.sort_array(F.transform(kept, lambda y: F.struct(y["i"], y["x"]))), lambda y: y["x"])
