"""The model graph: sources, models and tiles, and what depends on what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import graph, relational
from ..schemas import edge_violations, require_none
from ..session import written

LAYERS = {"source": 0, "staging": 1, "intermediate": 2, "marts": 3, "tile": 4}


class GraphError(ValueError):
    """Metadata that doesn't form an acyclic graph of known assets."""


def layer_rank(layer):
    """Order of layers; unknown ones last."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])[layer], F.lit(99))


def build_dag(models: DataFrame, sources: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, layer; edges): references between models, and what tiles read, whatever the case of names."""
    nodes = sources.select("id", F.lit("source").alias("kind"), F.lit("source").alias("layer"))
    nodes = nodes.union(models.select("id", F.lit("model"), "layer")).union(tiles.select("id", F.lit("tile"), F.lit("tile")))
    named = sources.select(F.lower("relation_name").alias("relation"), F.col("id").alias("source_id")).union(models.select(F.lower("relation_name"), "id"))
    require_none(relational.duplicated(named, ["relation"]), "relations of one name", GraphError)
    reads = tiles.select(F.col("id").alias("target_id"), "evidence", F.explode("queried_tables").alias("table"))
    reads = reads.select("target_id", "evidence", F.lower("table").alias("relation")).dropDuplicates(["target_id", "relation"])
    require_none(relational.unmatched(reads, named, ["relation"]), "tiles read unknown relations", GraphError)
    of_model = lambda ends, kind: models.select(ends.alias("source_id"), F.col("id").alias("target_id"), F.lit(kind).alias("kind"), "evidence")
    edges = of_model(F.explode("source_ids"), "model_dependency").unionByName(of_model(F.explode(F.transform("refs", lambda r: F.concat(F.lit("model."), r))), "model_dependency"))
    edges = edges.unionByName(reads.join(named, "relation").select("source_id", "target_id", F.lit("tile_dependency").alias("kind"), "evidence"))
    edges = written(edges, "dag")
    require_none(relational.duplicated(edges, ["source_id", "target_id"]), "dependencies given twice", GraphError)
    require_none(edge_violations(edges).select("source_id", "target_id"), "invalid dependencies", GraphError)
    graph.assert_acyclic(nodes.select(F.col("id").alias("node")), edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    return nodes, edges


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, `fingerprint`: a digest of the nodes' and of the edges' fingerprints, the same in any order."""
    of_nodes = hashing.table_fingerprint(nodes, "id", "kind", "layer").select(F.col("fingerprint").alias("n"))
    of_edges = hashing.table_fingerprint(edges, "source_id", "target_id", "kind").select(F.col("fingerprint").alias("e"))
    return of_nodes.join(F.broadcast(of_edges)).select(F.sha2(F.concat_ws(",", "n", "e"), 256).alias("fingerprint"))  # a row each


def models_by_layer(models: DataFrame) -> DataFrame:
    return models.groupBy("layer").agg(F.count(F.lit(1)).alias("models"))


def by_layer(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.counts_by_layer(nodes.select(F.col("id").alias("node"), "layer"), edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
