"""The structural checks: each takes metadata tables and gives findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import graph, overlap, relational, usage
from .lineage import Lineage, column_edges

NULL = F.lit


def findings(df: DataFrame, kind: str, id_: Column, summary: Column, assets: Column, evidence: Column, confidence: Column | None = None, detector: str = "deterministic") -> DataFrame:
    return df.select(id_.alias("id"), F.lit(kind).alias("defect_type"), summary.alias("summary"), assets.alias("asset_ids"), evidence.alias("evidence"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"), F.lit(detector).alias("detector"))


def orphaned_models(models: DataFrame, edges: DataFrame) -> DataFrame:
    """Models that no model and no tile reads."""
    alone = relational.orphans(models, edges, "id", "source_id")
    return findings(alone, "orphaned_model", F.concat(F.lit("orphaned_model:"), "name"), F.concat(F.lit("Model "), "name", F.lit(" is read by no model and no tile.")), F.array("id"), F.col("evidence"))


def stale_dashboards(dashboards: DataFrame, log: DataFrame, log_path: str, as_of: dt.datetime, days: int = 120) -> DataFrame:
    """Dashboards last queried `days` or more ago; those that the log doesn't know aren't reported."""
    old = usage.stale(log, ["dashboard_id"], "timestamp", as_of, days).withColumnRenamed("dashboard_id", "id").join(dashboards, "id")
    locator = F.concat(F.lit("dashboard_id="), "id", F.lit("/max(timestamp)="), hashing.utc_text(F.col("last_used")))
    pointer = F.struct(F.lit("query_log").alias("source"), F.lit(log_path).alias("uri"), locator.alias("locator"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("excerpt"))
    summary = F.concat(F.lit("Dashboard "), "id", F.lit(" was last queried at "), hashing.utc_text(F.col("last_used")), F.lit("."))
    return findings(old, "stale_asset", F.concat(F.lit("stale_asset:"), "id"), summary, F.array(F.concat(F.lit("dashboard."), "id")), F.concat(F.array(pointer), "evidence"))


def duplicate_dashboards(dashboards: DataFrame, tiles: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of dashboards that share their tiles: same first label, same canonical SQL."""
    signature = F.sha2(F.concat_ws("|", F.lower(F.get("metric_labels", F.lit(0))), text.canonical_text(F.col("query_sql"))), 256)
    pairs = overlap.set_overlap_pairs(tiles.select("dashboard_id", signature.alias("signature")), "dashboard_id", "signature", least)
    side = lambda s: dashboards.select(F.col("id").alias(f"{s}_id"), F.col("evidence").alias(f"{s}_evidence"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    summary = F.concat(F.lit("Dashboards "), "left_id", F.lit(" and "), "right_id", F.lit(" share "), text.percent(F.col("ratio")), F.lit(" of their tiles."))
    assets = F.array(F.concat(F.lit("dashboard."), "left_id"), F.concat(F.lit("dashboard."), "right_id"))
    return findings(both, "duplicate_dashboard", F.concat_ws(":", F.lit("duplicate_dashboard"), "left_id", "right_id"), summary, assets, F.concat("left_evidence", "right_evidence"), F.col("ratio"))


def broken_references(lineage: Lineage) -> DataFrame:
    """Columns that a query takes from a relation that doesn't have them, with the tiles that they reach."""
    missing = lineage.unresolved.filter("reason_code = 'missing_upstream_column'")
    ids = lineage.columns.select(F.col("id").alias("target_id"), F.col("parent_id").alias("parent"), F.col("name").alias("column"))
    missing = missing.join(ids, "target_id")
    reached = graph.closure(column_edges(lineage), missing.select(F.col("target_id").alias("node")))
    tiles = lineage.columns.filter("asset_kind = 'tile'").select(F.col("id").alias("dst"), F.col("parent_id").alias("tile"))
    affected = reached.join(tiles, "dst").groupBy(F.col("src").alias("target_id")).agg(F.array_sort(F.collect_set(F.struct("dst", "tile"))).alias("tiles"))
    missing = missing.join(affected, "target_id", "left")
    assets = F.array_distinct(F.concat(F.array("parent"), F.coalesce(F.transform("tiles", lambda x: x["tile"]), F.array().cast("array<string>"))))
    summary = F.concat(F.lit("Column "), "column_name", F.lit(" of "), "upstream_relation", F.lit(" doesn't exist, but "), "parent", F.lit(" selects it."))
    return findings(missing, "broken_lineage", F.concat(F.lit("broken_lineage:"), "parent", F.lit("."), "column"), summary, assets, F.col("evidence"))


def unused_propagation(lineage: Lineage, least: int = 10) -> DataFrame:
    """Models whose star brings in `least` or more columns that nothing reads."""
    star = lineage.columns.filter("asset_kind = 'model' and star_expanded")
    unused = relational.unused_columns(star, lineage.edges, "parent_id", "id", "name", "source_id", least)
    unused = unused.join(lineage.columns.groupBy("parent_id").agg(F.first("evidence").alias("evidence")), "parent_id")
    name = text.without_prefix(F.col("parent_id"), "model.")
    summary = F.concat(F.lit("Model "), name, F.lit(" passes on "), F.col("unused").cast("string"), F.lit(" columns that nothing reads: "), "names", F.lit("."))
    return findings(unused, "unused_column_propagation", F.concat(F.lit("unused_column_propagation:"), name), summary, F.array("parent_id"), F.col("evidence"))
