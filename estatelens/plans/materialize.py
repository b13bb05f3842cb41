"""Models run in their order: views and ephemeral models stay plans, tables are written once and read by all that refer to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import written
from .lineage import Catalog, topological
from .sqltext import relations

KINDS = ("view", "ephemeral", "table")


def run_models(spark: SparkSession, models: DataFrame, relations_: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every model's result by its relation name; models: name, relation_name, materialization, resolved_sql, refs.

    relations_: the sources. Names are found whatever their case, with or without the catalog
    that all three-part names share. A model of no materialisation is a view.
    """
    held, catalog = dict(relations_), Catalog()
    for name in held:
        catalog.add(name, [], name, [])
    for m in topological(models.collect()):
        kind = m["materialization"] or "view"
        if kind not in KINDS:
            raise ValueError(f"{m['name']}: no materialisation {kind}")
        result = _run(spark, m["resolved_sql"], catalog, held)
        held[m["relation_name"].lower()] = written(result, m["name"]) if kind == "table" else result
        catalog.add(m["relation_name"], [], m["relation_name"], [])
    return {name: df for name, df in held.items() if name not in relations_}


def _run(spark: SparkSession, sql: str, catalog: Catalog, held: dict[str, DataFrame]) -> DataFrame:
    """A query whose relations are DataFrames; places of names are those that the parser gives."""
    text, inputs = sql.strip().rstrip(";"), {}
    for t in reversed(relations(spark, text)):
        name = catalog.named(t.name)
        if name not in held:
            raise ValueError(f"no relation {t.name}")
        inputs[f"r{len(inputs)}"] = held[name]
        text = text[: t.start] + f"{{r{len(inputs) - 1}}}" + text[t.stop + 1 :]
    return spark.sql(text, **inputs)
