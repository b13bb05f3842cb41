"""Schemas of the metadata tables, and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "struct<source:string,uri:string,locator:string,content_hash:string,excerpt:string>"
SOURCES = f"id string, source_name string, table_name string, database string, schema_name string, relation_name string, columns array<string>, path string, evidence array<{EVIDENCE}>"
DASHBOARDS = "schema_version bigint, seed bigint, generated_as_of string, dashboards array<struct<id:string,title:string,description:string,tiles:array<struct<id:string,title:string,metric_label:string,sql:string>>>>"
QUERY_LOG = ["dashboard_id", "tile_id", "user", "timestamp"]
EDGES = f"source_id string, target_id string, kind string, evidence array<{EVIDENCE}>"
COLUMNS = f"id string, name string, parent_id string, relation_name string, asset_kind string, star_expanded boolean, expression_sql string, evidence array<{EVIDENCE}>"
UNRESOLVED = f"target_id string, upstream_relation string, column_name string, reason_code string, reason string, expression_sql string, evidence array<{EVIDENCE}>"
FINDINGS = f"id string, defect_type string, summary string, asset_ids array<string>, evidence array<{EVIDENCE}>, confidence double, detector string"

EDGE_KINDS = ["model_dependency", "tile_dependency", "column_lineage", "query_observed", "unresolved"]
DEFECT_TYPES = ["metric_definition_conflict", "duplicate_dashboard", "stale_asset", "orphaned_model", "broken_lineage", "unused_column_propagation"]
DETECTORS = ["deterministic", "semantic_llm"]


def edge_violations(edges: DataFrame) -> DataFrame:
    """Edges that loop on themselves, name no end, have no evidence or an unknown kind."""
    named = (F.length("source_id") > 0) & (F.length("target_id") > 0)
    good = named & (F.col("source_id") != F.col("target_id")) & (F.size("evidence") >= 1) & F.col("kind").isin(EDGE_KINDS)
    return edges.filter(~F.coalesce(good, F.lit(False)))


def finding_violations(findings: DataFrame) -> DataFrame:
    """Findings without id, assets or evidence, with a confidence outside 0 to 1, or a judged finding of a structural type."""
    good = (F.length("id") > 0) & (F.size("asset_ids") >= 1) & (F.size("evidence") >= 1) & F.col("confidence").between(0, 1) & F.col("defect_type").isin(DEFECT_TYPES) & F.col("detector").isin(DETECTORS)
    scoped = (F.col("detector") != "semantic_llm") | (F.col("defect_type") == "metric_definition_conflict")
    return findings.filter(~F.coalesce(good & scoped, F.lit(False)))


def require_none(violations: DataFrame, what: str, error: type[Exception] = ValueError) -> None:
    """Raises if there is a row; the message names the first few."""
    found = violations.limit(5).collect()
    if found:
        raise error(f"{what}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items() if not isinstance(v, list))[:200] for r in found))
