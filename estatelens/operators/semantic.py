"""Comparing definitions: containment of items in texts, verdict rules over candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_windows

RUN = 4  # words by which an item and a text find each other
SHORT_BYTES = 1 << 20  # of items without an inner word that meet every text at once


def _runs(words, size: int):
    """Hashes of all runs of so many words."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.lit(size), F.slice(words, i, F.lit(size)))))).otherwise(F.array().cast("array<bigint>"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, hits, first_doc) of the items whose text stands in a document, word for word.

    What stands between two spaces of an item stands between spaces of a text that holds it. So
    the first RUN of an item's inner words are a key, runs of that many words of the texts meet
    it in an equality join, and the pairs that come of it are tested on the texts. Items of two
    words or fewer have no inner word; they meet all texts in blocks of SHORT_BYTES.
    """
    docs = docs.select("doc_id", "text").filter("text is not null")
    items = items.select("item_id", F.col("text").alias("item_text")).filter("item_text is not null").withColumn("inner", F.split("item_text", " ", -1))
    items = items.withColumn("inner", F.slice("inner", 2, F.greatest(F.size("inner") - 2, F.lit(0)))).withColumn("size", F.least(F.size("inner"), F.lit(RUN)))
    keyed = items.filter("size > 0").withColumn("key", F.xxhash64("size", F.slice("inner", F.lit(1), F.col("size"))))
    words = docs.select("doc_id", F.split("text", " ", -1).alias("w"))
    sizes = [r[0] for r in keyed.select("size").distinct().collect()]  # 1 to RUN
    met = docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint")
    if sizes:
        keys = words.select("doc_id", F.explode(F.concat(*[_runs(F.col("w"), n) for n in sizes])).alias("key"))
        pairs = keys.join(keyed.select("key", "item_id", "item_text"), "key").select("doc_id", "item_id", "item_text").distinct().withColumnRenamed("doc_id", "doc")
        met = pairs.join(docs, F.col("doc").eqNullSafe(F.col("doc_id"))).filter(F.contains("text", F.col("item_text"))).select("item_id", "doc_id")
    for block in _blocks(items.filter("size = 0")):
        met = met.union(docs.join(F.broadcast(block), F.contains("text", F.col("item_text"))).select("item_id", "doc_id"))
    return met.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first_doc"))


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items in tables of at most SHORT_BYTES each, or one item."""
    size = items.agg(F.sum(F.octet_length("item_text").cast("long"))).first()[0]
    if size is None:
        return []
    n = -(-size // SHORT_BYTES) or 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)) == i).select("item_id", "item_text") for i in range(n)]


def judged(candidates: DataFrame) -> DataFrame:
    """candidates (metric_name, left_sql, right_sql, left_primary, right_primary) with verdict, rationale and confidence, by fixed rules.

    Different day windows on both sides: drifted. A total revenue of which one side alone
    mentions refunds: drifted. A net revenue of which one side alone has either form of the
    same subtraction: equivalent. Anything else: unrelated.
    """
    left, right = (F.array_sort(day_windows(F.col(f"{side}_sql"))) for side in ("left", "right"))
    mentions = lambda side, what: F.contains(F.lower(side), F.lit(what))
    windows = (F.size(left) > 0) & (F.size(right) > 0) & (left != right)
    refunds = (F.col("metric_name") == "total_revenue") & (mentions("left_primary", "refund") != mentions("right_primary", "refund"))
    forms = F.array(*[mentions(side, what) for side in ("left_sql", "right_sql") for what in ("net_amount", "amount - refunds")])
    net = (F.col("metric_name") == "net_revenue") & F.exists(forms, lambda x: x) & F.exists(forms, lambda x: ~x)
    rule = lambda verdict, why, sure: F.struct(F.lit(verdict).alias("verdict"), F.lit(why).alias("rationale"), F.lit(sure).alias("confidence"))
    chosen = F.when(windows, rule("drifted", "the time windows differ", 1.0)).when(refunds, rule("drifted", "one side alone subtracts refunds", 1.0))
    chosen = chosen.when(net, rule("equivalent", "two forms of one subtraction", 0.95)).otherwise(rule("unrelated", "no rule finds a drift", 0.9))
    return candidates.withColumn("__v", chosen).select(*candidates.columns, "__v.*")
