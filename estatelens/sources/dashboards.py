"""Dashboard exports: strict nested JSON, tiles as rows, the relations that their SQL reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational
from ..plans.sqltext import SqlError, relations
from ..schemas import DASHBOARDS, require_none


class DashboardError(ValueError):
    """An export that doesn't keep its contract."""


def _extra(found: T.DataType, declared: T.DataType, where: str = "") -> list[str]:
    """Fields of an inferred schema that the declared one doesn't have."""
    if isinstance(found, T.ArrayType) and isinstance(declared, T.ArrayType):
        return _extra(found.elementType, declared.elementType, where)
    if not (isinstance(found, T.StructType) and isinstance(declared, T.StructType)):
        return []
    known = {f.name: f.dataType for f in declared}
    return [x for f in found for x in ([f"{where}{f.name}"] if f.name not in known else _extra(f.dataType, known[f.name], f"{where}{f.name}."))]


def load_dashboards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(dashboards, tiles, generated_as_of)."""
    schema = T._parse_datatype_string(DASHBOARDS) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], DASHBOARDS).schema
    reader = spark.read.option("multiLine", "true")
    if extra := _extra(reader.json(path).schema, schema):
        raise DashboardError(f"{path}: unknown fields {extra}")
    catalog = reader.schema(schema).option("mode", "FAILFAST").json(path)
    as_of = catalog.first()["generated_as_of"]
    each = catalog.select(F.explode("dashboards").alias("d")).select("d.*")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    missing = each.filter(blank("id") | blank("title") | F.col("tiles").isNull())
    require_none(missing.select("id"), "dashboards without id, title or tiles", DashboardError)
    require_none(relational.duplicated(each, ["id"]), "dashboards of one id", DashboardError)
    pointer = lambda locator, body: F.array(F.struct(F.lit("dashboard_metadata").alias("source"), F.lit(path).alias("uri"), locator.alias("locator"), F.sha2(body, 256).alias("content_hash"), F.lit(None).cast("string").alias("excerpt")))
    dashboards = each.select("id", "title", "description", pointer(F.concat(F.lit("dashboard="), "id"), F.to_json(F.struct("description", "id", "tiles", "title"))).alias("evidence"))
    tiles = each.select(F.col("id").alias("dashboard_id"), F.explode("tiles").alias("t")).select("dashboard_id", F.col("t.id").alias("tile_id"), "t.title", "t.metric_label", F.col("t.sql").alias("query_sql"))
    require_none(tiles.filter(blank("tile_id") | blank("title") | blank("metric_label") | blank("query_sql")).select("dashboard_id", "tile_id"), "tiles without id, title, label or SQL", DashboardError)
    require_none(relational.duplicated(tiles, ["tile_id"]), "tiles of one id", DashboardError)
    reads = []
    for tile_id, sql in tiles.select("tile_id", "query_sql").collect():  # SQL is parsed where the session's parser is
        try:
            found = relations(spark, sql)
        except SqlError as e:
            raise DashboardError(f"{path}: tile {tile_id}: {e}") from e
        if not found:
            raise DashboardError(f"{path}: tile {tile_id} reads no table")
        reads.append((tile_id, list(dict.fromkeys(r.name for r in found))))
    tiles = tiles.join(spark.createDataFrame(reads, "tile_id string, queried_tables array<string>"), "tile_id")
    locator = F.concat(F.lit("dashboard="), "dashboard_id", F.lit("/tile="), "tile_id")
    tiles = tiles.withColumn("id", F.concat_ws(".", F.lit("tile"), "dashboard_id", "tile_id")).withColumn("metric_labels", F.array("metric_label"))
    return dashboards, tiles.withColumn("evidence", pointer(locator, F.to_json(F.struct("metric_label", F.col("query_sql").alias("sql"), "tile_id", "title")))), as_of
