"""SQL transformation projects: declared sources, templated models, references."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from ..schemas import require_none
from .declared import DeclaredTables


class ProjectError(ValueError):
    """A project that doesn't keep its contract."""


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.decode("content", "UTF-8").alias("body"))


def load_yaml(spark: SparkSession, path: str):
    """A YAML file through Spark's reader, so from any store that it reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        return yaml.safe_load(rows[0][0]) if rows else None
    except yaml.YAMLError as e:
        raise ProjectError(f"{path}: not YAML: {e}") from e


def load_sources(spark: SparkSession, root: str) -> DataFrame:
    """The tables that YAML files below root declare; unknown fields and repeated names are errors."""
    spark.dataSource.register(DeclaredTables)
    found = spark.read.format("declared_tables").load(root)
    require_none(found.filter("error is not null").select("path", "error"), "declarations that break the contract", ProjectError)
    out = found.filter("error is null").drop("error")
    require_none(relational.duplicated(out, ["id"]), "sources declared twice", ProjectError)
    return out


def load_models(spark: SparkSession, root: str, config: dict, sources: DataFrame, schema: str = "analytics", database: str | None = None) -> DataFrame:
    """The project's models with layers, references and SQL in which references are relation names."""
    models = None
    for folder in config.get("model-paths") or []:
        own = _files(spark, f"{root}/{folder}", "*.sql").withColumn("below", F.expr(f"element_at(split(path, '/{re.escape(folder)}/'), -1)"))
        models = own if models is None else models.union(own)
    if models is None:
        raise ProjectError(f"{root}: no model-paths")
    layer = F.when(F.contains("below", F.lit("/")), F.substring_index("below", "/", 1)).otherwise("models")
    materialized = {k: v.get("materialized") for k, v in ((config.get("models") or {}).get(config["name"]) or {}).items() if isinstance(v, dict)}
    lookup = F.create_map(*[F.lit(x) for pair in materialized.items() for x in pair])[F.col("layer")] if materialized else F.lit(None).cast("string")
    models = models.select(F.regexp_extract("path", r"([^/]+)\.sql$", 1).alias("name"), layer.alias("layer"), "path", F.col("body").alias("raw_sql"))
    models = models.withColumn("id", F.concat(F.lit("model."), "name")).withColumn("materialization", lookup)
    prefix = ".".join(p for p in (database, schema) if p)
    models = models.withColumn("relation_name", F.concat(F.lit(prefix + "."), "name"))
    models = models.withColumn("refs", F.array_distinct(F.regexp_extract_all("raw_sql", F.lit(text.REF), F.lit(2))))
    pairs = F.zip_with(F.regexp_extract_all("raw_sql", F.lit(text.SOURCE), F.lit(2)), F.regexp_extract_all("raw_sql", F.lit(text.SOURCE), F.lit(4)), lambda a, b: F.struct(a.alias("source_name"), b.alias("table_name")))
    models = models.withColumn("pairs", F.array_distinct(pairs))
    require_none(relational.duplicated(models, ["name"]), "models of one name", ProjectError)
    require_none(relational.unmatched(models.select(F.explode("refs").alias("name")), models, ["name"]), "references to unknown models", ProjectError)
    used = models.select("id", F.posexplode("pairs").alias("place", "pair")).select("id", "place", "pair.*")
    require_none(relational.unmatched(used, sources, ["source_name", "table_name"]), "references to unknown sources", ProjectError)
    named = used.join(sources.select("source_name", "table_name", F.col("id").alias("source_id"), F.col("relation_name").alias("relation")), ["source_name", "table_name"])
    named = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "source_name", "table_name", "relation", "source_id"))).alias("used"))
    models = models.join(named, "id", "left").withColumn("used", F.coalesce("used", F.expr("cast(array() as array<struct<place:int,source_name:string,table_name:string,relation:string,source_id:string>>)")))
    pattern = lambda x: F.concat(F.lit(r"\{\{\s*source\(\s*['\"]"), F.replace(x["source_name"], F.lit("."), F.lit(r"\.")), F.lit(r"['\"]\s*,\s*['\"]"), F.replace(x["table_name"], F.lit("."), F.lit(r"\.")), F.lit(r"['\"]\s*\)\s*\}\}"))
    resolved = F.aggregate("used", F.regexp_replace("raw_sql", text.REF, f"{prefix}.$2"), lambda sql, x: F.regexp_replace(sql, pattern(x), x["relation"]))
    models = models.withColumn("resolved_sql", resolved).withColumn("source_ids", F.transform("used", lambda x: x["source_id"]))
    require_none(models.filter(text.has_template(F.col("resolved_sql"))).select("name"), "templates beyond ref and source", ProjectError)
    evidence = F.array(F.struct(F.lit("dbt_sql").alias("source"), F.col("path").alias("uri"), F.concat(F.lit("model="), "name").alias("locator"), F.sha2("raw_sql", 256).alias("content_hash"), F.lit(None).cast("string").alias("excerpt")))
    return models.withColumn("evidence", evidence).select("id", "name", "layer", "materialization", "relation_name", "raw_sql", "resolved_sql", "refs", "source_ids", "path", "evidence")


def load_project(spark: SparkSession, root: str, schema: str = "analytics", database: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, sources) of the project whose dbt_project.yml lies in root."""
    config = load_yaml(spark, f"{root}/dbt_project.yml")
    if not isinstance(config, dict) or "name" not in config:
        raise ProjectError(f"{root}: the project has no name")
    sources = load_sources(spark, root)
    return load_models(spark, root, config, sources, schema, database), sources
