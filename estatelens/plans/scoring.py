"""Findings against a manifest of planted defects and of look-alikes that must not be found."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.substring import containment_pairs
from ..session import written
from ..sources.project import load_yaml


@dataclass
class Scorecard:
    """Hits and misses of each defect, false alarms, findings that match nothing."""

    per_defect: list[dict] = field(default_factory=list)
    flagged_negative_ids: list[str] = field(default_factory=list)
    unmatched_finding_ids: list[str] = field(default_factory=list)
    finding_count: int = 0

    @property
    def hits(self) -> int:
        return sum(d["hit"] for d in self.per_defect)

    @property
    def recall(self) -> float:
        return self.hits / len(self.per_defect) if self.per_defect else 1.0

    def as_dict(self) -> dict:
        return asdict(self) | {"hits": self.hits, "total_positives": len(self.per_defect), "recall": self.recall, "false_positive_count_against_negatives": len(self.flagged_negative_ids)}


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(place, expected, id, type, path, locator, n_locations): one row for each location."""
    manifest, rows, place = load_yaml(spark, path), [], 0
    for kind in ("defects", "negatives"):
        for item in manifest[kind]:
            locations = item.get("locations") or []
            for at in locations or [{}]:
                rows.append((place, kind, item["id"], item["type"], at.get("path"), at.get("locator"), len(locations)))
            place += 1
    return spark.createDataFrame(rows, "place int, expected string, id string, type string, path string, locator string, n_locations int")


def location_matches(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(place, expected, finding, matched, n_locations): how many locations of an item a finding of its type meets, if any.

    Pairs come from containment_pairs, one group for each type and rule of
    text.location_matches, and are then tested by that function.
    """
    side = findings.select(F.col("id").alias("finding"), F.col("defect_type").alias("type"), "asset_ids", F.transform("evidence", lambda e: e["locator"]).alias("locators"), F.transform("evidence", lambda e: e["uri"]).alias("uris"))
    side = written(side, "findings")
    items = manifest.select("place", "expected", "type", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("locator", F.lit("")).alias("locator"), "n_locations")
    items = items.groupBy(*items.columns).agg(F.count(F.lit(1)).alias("times"))
    items = written(items.withColumn("item", F.sha2(F.to_json(F.struct("place", "expected", "type", "path", "locator")), 256)), "items")

    parts = text.location_needles(F.col("locator"), F.col("path"))
    needles = [items.select(F.col("item").alias("needle_id"), _grp(rule), needle.alias("text")) for rule, needle in parts.items()]
    hays = [side.select(F.col("finding").alias("hay_id"), _grp(rule), F.explode(texts).alias("text")) for rule, texts in text.location_hays(F.col("locators"), F.col("asset_ids"), F.col("uris")).items()]
    pairs = containment_pairs(_all(needles), _all(hays)).select(F.col("needle_id").alias("item"), F.col("hay_id").alias("finding"))
    # the first rule holds the other way round too
    inner = containment_pairs(side.select(F.col("finding").alias("needle_id"), _grp(""), F.explode(F.transform("locators", F.lower)).alias("text")), items.select(F.col("item").alias("hay_id"), _grp(""), F.lower("locator").alias("text")))
    pairs = pairs.union(inner.select(F.col("hay_id").alias("item"), F.col("needle_id").alias("finding"))).distinct()

    both = pairs.join(items, "item").join(side, ["finding", "type"])
    met = both.filter(text.location_matches(F.col("locator"), F.col("path"), F.col("locators"), F.col("asset_ids"), F.col("uris")))
    return met.groupBy("place", "expected", "finding", "n_locations").agg(F.sum("times").alias("matched"))


def _grp(rule: str) -> Column:
    return F.concat_ws("|", F.lit(rule), "type").alias("grp")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def ranked(matches: DataFrame) -> DataFrame:
    """matches with `rank`: an item's findings by how many locations they meet, of equals by id."""
    order = Window.partitionBy("place").orderBy(F.desc("matched"), "finding")
    return matches.withColumn("rank", F.row_number().over(order))


def assigned(matches: DataFrame) -> DataFrame:
    """(place, finding): items in the order of their places each take the free finding with most matches, the first of equals by id.

    In a round an item takes its best free finding if no item before it could still want that
    finding; the first free item always can. Both leave the table, the rest is written. Rounds
    are as many as items that wait for one another in a row.
    """
    left, found = written(matches.filter("matched > 0").select("place", "finding", "matched"), "matches"), []
    while not left.isEmpty():
        best = left.groupBy("place").agg(F.min_by("finding", F.struct(-F.col("matched"), "finding")).alias("finding"))
        first = left.groupBy("finding").agg(F.min("place").alias("place"))
        taken = written(best.join(first, ["place", "finding"]), "taken")
        found.append(taken)
        left = written(left.join(taken.select("place"), "place", "left_anti").join(taken.select("finding"), "finding", "left_anti"), "matches")
    return _all(found) if found else matches.select("place", "finding").limit(0)


def scored(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(place, expected, id, type, hit, finding_id) for each item: a defect is hit if it takes a finding, a look-alike if one meets all its locations."""
    matches = written(location_matches(findings, manifest), "matches")
    taken = assigned(matches.filter("expected = 'defects'")).withColumnRenamed("finding", "finding_id")
    flagged = matches.filter("expected = 'negatives' and matched = n_locations").select("place", F.lit(True).alias("flagged")).distinct()
    items = manifest.select("place", "expected", "id", "type").distinct()
    hit = F.col("finding_id").isNotNull() | F.col("flagged").isNotNull()
    return items.join(taken, "place", "left").join(flagged, "place", "left").select("place", "expected", "id", "type", hit.alias("hit"), "finding_id")


def score(findings: DataFrame, manifest: DataFrame) -> Scorecard:
    """The report on scored(): its lines and the findings that no item took."""
    lines = written(scored(findings, manifest), "scored")
    out = Scorecard(finding_count=findings.count())
    for r in lines.orderBy("place").toLocalIterator():
        if r["expected"] == "negatives":
            out.flagged_negative_ids += [r["id"]] if r["hit"] else []
        else:
            out.per_defect.append({"id": r["id"], "defect_type": r["type"], "hit": r["hit"], "finding_id": r["finding_id"]})
    rest = findings.select("id").join(lines.select(F.col("finding_id").alias("id")), "id", "left_anti")
    out.unmatched_finding_ids = [r["id"] for r in rest.orderBy("id").toLocalIterator()]
    return out
