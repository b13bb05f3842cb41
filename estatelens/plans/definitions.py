"""Conflicts of metric definitions: candidate pairs, judged and merged into findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import relational, semantic
from ..operators.usage import total_order
from ..schemas import require_none
from ..session import written
from .checks import findings
from .sqltext import canonical_sql

VERDICTS = ["drifted", "equivalent", "unrelated"]
PROMPT_VERSION = 1
CALLS_PER_TASK = 16


class JudgeError(ValueError):
    """A judge's answer that doesn't keep its contract."""


class Provider(Protocol):
    """What an external judge offers: a name, a model, and JSON for a prompt; perhaps `usage`, the tokens of the last prompt and answer."""

    name: str
    model: str

    def complete(self, prompt: str) -> str: ...


def normalised(spark: SparkSession, items: DataFrame, id_col: str, sql: str) -> DataFrame:
    """(id, norm): definitions by what they parse to. Each distinct text is parsed once, where the session's parser is; texts come in one partition at a time."""
    texts = written(items.select(F.col(id_col).cast("string").alias("id"), F.col(sql).alias("sql")), "texts")
    norms = [(r[0], canonical_sql(spark, r[0])) for r in texts.select("sql").distinct().toLocalIterator()]
    return texts.join(spark.createDataFrame(norms, "sql string, norm string"), "sql").select("id", "norm")


def candidates(spark: SparkSession, models: DataFrame, tiles: DataFrame, aggregates: dict[str, list[str]]) -> DataFrame:
    """Pairs of tiles of one label, and of models with an aggregate of one name, whose definitions differ."""
    reads = tiles.select("id", F.posexplode("queried_tables").alias("place", "table"))
    by_name = models.select(F.col("name").alias("model"), F.lower("relation_name").alias("relation"), "resolved_sql")
    reads = reads.select("*", F.concat_ws("#", "id", "place").alias("read"), F.lower("table").alias("relation"), F.element_at(F.split("table", r"\."), -1).alias("last"))
    best = relational.first_match(reads, by_name, "read", [("relation", "relation"), ("last", "model")], "model").select("id", "place", F.col("match").alias("m")).filter("m is not null")
    part = F.concat(F.lit("\n-- upstream model "), "m.model", F.lit("\n"), F.trim(F.col("m.resolved_sql")))
    suffix = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("sql")))), lambda x: x["sql"]), "").alias("suffix"))
    full_sql = tiles.join(suffix, "id", "left").select("id", F.trim("query_sql").alias("primary"), F.concat(F.trim("query_sql"), F.coalesce("suffix", F.lit(""))).alias("sql"), "evidence", text.label_name(F.get("metric_labels", F.lit(0))).alias("label"))
    of_tiles = full_sql.join(normalised(spark, full_sql, "id", "sql"), "id").withColumn("match_kind", F.lit("same_metric_label"))

    outputs = spark.createDataFrame([(m, c) for m, cs in aggregates.items() if m.startswith("model.") for c in cs], "id string, label string")
    of_models = models.select("id", F.trim("resolved_sql").alias("primary"), F.trim("resolved_sql").alias("sql"), "evidence").join(outputs, "id")
    of_models = of_models.join(normalised(spark, models, "id", "resolved_sql"), "id").withColumn("match_kind", F.lit("same_column_name"))

    def paired(items: DataFrame, prefix: str) -> DataFrame:
        items = items.withColumn("asset", F.col("id")).withColumn("id", F.element_at(F.split("id", r"\."), -1))
        pairs = relational.conflicting_pairs(items, "id", "label", "norm")
        side = lambda s: items.select(F.col("id").alias(f"{s}_id"), "label", F.col("asset").alias(f"{s}_asset"), F.col("sql").alias(f"{s}_sql"), F.col("primary").alias(f"{s}_primary"), F.col("evidence").alias(f"{s}_evidence"))
        both = pairs.join(side("left"), ["left_id", "label"]).join(side("right"), ["right_id", "label"])
        kind = "same_metric_label" if prefix == "label" else "same_column_name"
        return both.select(F.concat_ws(":", F.lit(prefix), "label", "left_id", "right_id").alias("id"), F.lit(kind).alias("match_kind"), F.col("label").alias("metric_name"), F.col("left_asset").alias("left_asset_id"), F.col("right_asset").alias("right_asset_id"), "left_sql", "right_sql", "left_primary", "right_primary", F.concat("left_evidence", "right_evidence").alias("evidence"))

    return paired(of_tiles, "label").unionByName(paired(of_models, "column"))


def judge(pairs: DataFrame) -> DataFrame:
    """Candidates with verdicts by the fixed rules; the quotes are the definitions themselves."""
    out = semantic.judged(pairs)
    return out.withColumn("left_sql_quote", F.col("left_sql")).withColumn("right_sql_quote", F.col("right_sql"))


def prompt(pair: dict) -> str:
    return f"Metric: {pair['metric_name']}\nDo these two definitions agree? Quote both word for word.\nLEFT {pair['left_asset_id']}:\n{pair['left_sql']}\nRIGHT {pair['right_asset_id']}:\n{pair['right_sql']}\nAnswer as JSON with candidate_id ({pair['id']}), verdict ({', '.join(VERDICTS)}), rationale, left_sql_quote, right_sql_quote, confidence."


ANSWER = "struct<candidate_id:string,verdict:string,rationale:string,left_sql_quote:string,right_sql_quote:string,confidence:double>"
_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
_SHAPE = rf"^OBJECT<candidate_id: STRING, confidence: {_NUMBER}, left_sql_quote: STRING, rationale: STRING, right_sql_quote: STRING, verdict: STRING>$"


def answer_errors(answers: DataFrame) -> DataFrame:
    """answers (id, left_sql, right_sql, raw, ...) with `answer` (the fields of raw) and `error`, null where the answer keeps its contract.

    An answer is JSON with exactly the fields asked for, about this candidate, with a known
    verdict, a confidence from 0 to 1, and two different quotes that stand in the definitions.
    """
    whole = F.try_parse_json("raw")
    out = answers.withColumn("answer", F.from_json("raw", ANSWER))
    a = lambda name: F.col(f"answer.{name}")
    quoted = lambda side: (a(f"{side}_sql_quote") != "") & F.contains(f"{side}_sql", a(f"{side}_sql_quote"))
    rules = [
        (whole.isNotNull(), "not JSON"),
        (F.schema_of_variant(whole).rlike(_SHAPE), "not the fields asked for"),
        ((a("candidate_id") == F.col("id")) & a("verdict").isin(VERDICTS) & a("confidence").between(0, 1), "another candidate, an unknown verdict or confidence"),
        (quoted("left") & quoted("right"), "a quote that isn't in the definition"),
        (a("left_sql_quote") != a("right_sql_quote"), "quotes that don't differ"),
    ]
    error = None
    for holds, why in rules:
        broken = ~F.coalesce(holds, F.lit(False))
        error = F.when(broken, why) if error is None else error.when(broken, why)
    return out.withColumn("error", error)


def cache_key(provider: str, model: str):
    """Key of a candidate's answer."""
    return F.sha2(F.to_json(F.struct(F.col("id"), F.col("left_sql"), F.lit(model).alias("model"), F.lit(provider).alias("provider"), F.lit(PROMPT_VERSION).alias("version"), F.col("right_sql"))), 256)


def with_cached(pairs: DataFrame, cache: DataFrame | None, provider: str, model: str) -> DataFrame:
    """pairs with `key` and the cache's answer to it, `raw`; null where the cache has none."""
    keyed = pairs.withColumn("key", cache_key(provider, model))
    if cache is None:
        return keyed.withColumn("raw", F.lit(None).cast("string"))
    return keyed.join(cache.groupBy("key").agg(F.min("raw").alias("raw")), "key", "left")


def usage_totals(asked: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """One row: requests (candidates without a held answer), cache_hits, prompt_tokens, completion_tokens and cost (the rules and held answers cost nothing; prices aren't known here)."""
    out = asked.agg(F.count_if(F.col("raw").isNull()).alias("requests"), F.count("raw").alias("cache_hits"))
    spark = asked.sparkSession
    usage = spark.createDataFrame([], "prompt_tokens bigint, completion_tokens bigint") if usage is None else usage
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return out.join(F.broadcast(usage.agg(total("prompt_tokens"), total("completion_tokens")))).withColumn("cost", F.lit(0.0))  # a row each


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The answers saved at path, None if there is nothing yet; a table of another shape is an error."""
    try:
        cache = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise JudgeError(f"{path}: not a cache of answers") from e
    if {f.name: f.dataType.simpleString() for f in cache.schema} != {"key": "string", "raw": "string"} or not cache.filter("key is null or raw is null").isEmpty():
        raise JudgeError(f"{path}: not a cache of answers")
    return cache


def save_answers(answers: DataFrame, path: str) -> None:
    """Adds answers that the cache at path doesn't hold."""
    held = load_cache(answers.sparkSession, path)
    new = answers.select("key", "raw") if held is None else answers.select("key", "raw").join(held, "key", "left_anti")
    written(new, "answers").write.mode("append").parquet(path)


ASKED = "key string, raw string, prompt_tokens bigint, completion_tokens bigint, error string"


def asked_in_tasks(asked: DataFrame, provider: Provider, tasks: int, keep: Callable[[DataFrame], None] | None = None, calls: int = CALLS_PER_TASK) -> DataFrame:
    """The ASKED rows of candidates without an answer, each key asked once, by at most `tasks` tasks at a time.

    Candidates go out in waves of `tasks` tasks with `calls` calls each. A wave's answers are
    written by Spark and handed to keep(key, raw) before the next one starts, so a lost executor
    repeats the calls of its own tasks, and a stopped run those of one wave. A call that the
    provider refuses doesn't lose the answers of its wave: they are kept, then JudgeError is
    raised. The provider is copied to the tasks; what it counts itself stays there.
    """
    if tasks < 1 or calls < 1:
        raise ValueError("tasks and calls must be 1 or more")
    wanted = [c for c in asked.columns if c not in ("key", "raw")]
    once = asked.filter("raw is null").groupBy("key").agg(*[F.first(c).alias(c) for c in wanted])
    placed = total_order(once, ["key"]).withColumn("wave", F.floor((F.col("place") - 1) / (tasks * calls)))
    placed = written(placed.withColumn("task", F.col("place") % tasks), "waves")

    def ask(frames):
        for frame in frames:
            for r in frame.to_dict("records"):
                try:
                    raw, why = provider.complete(prompt(r)), None
                except JudgeError as e:
                    raw, why = None, str(e)
                used = getattr(provider, "usage", (0, 0)) if why is None else (0, 0)
                yield pd.DataFrame([[r["key"], raw, *used, why]], columns=["key", "raw", "prompt_tokens", "completion_tokens", "error"])

    out = []
    for wave in range((placed.agg(F.max("wave")).first()[0] or 0) + 1):
        own = placed.filter(F.col("wave") == wave).repartitionByRange(tasks, "task").select("key", "task", "id", "metric_name", "left_asset_id", "left_sql", "right_asset_id", "right_sql")
        told = written(own.mapInPandas(ask, ASKED), "told")
        if keep:
            keep(told.filter("error is null").select("key", "raw"))
        require_none(told.filter("error is not null").select("key", "error"), "calls that the judge refused", JudgeError)
        out.append(told)
    return reduce(DataFrame.union, out)


def judge_with(pairs: DataFrame, provider: Provider, cache: DataFrame | None = None, progress: Callable[[str], None] | None = None, tasks: int = 0, keep: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(judged pairs, all answers as key and raw, totals).

    A provider is asked by asked_in_tasks if tasks are given, else on the driver, one candidate
    at a time, as a provider with a state of its own needs it. Held answers are checked again like new ones.
    """
    spark = pairs.sparkSession
    asked = written(with_cached(pairs, cache, provider.name, provider.model), "asked")
    if tasks:
        got = asked_in_tasks(asked, provider, tasks, keep)
        return _told(pairs, asked, got.select("key", "raw"), got)
    new, used = [], []
    for r in asked.filter("raw is null").orderBy("id").toLocalIterator():
        new.append((r["key"], provider.complete(prompt(r.asDict()))))
        used.append(tuple(getattr(provider, "usage", (0, 0))))
        if progress:
            progress(f"judged {r['id']}: {used[-1][0]} + {used[-1][1]} tokens")
    return _told(pairs, asked, spark.createDataFrame(new, "key string, raw string"), spark.createDataFrame(used, "prompt_tokens bigint, completion_tokens bigint"))


def _told(pairs: DataFrame, asked: DataFrame, answers: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    told = asked.withColumnRenamed("raw", "held").join(answers, "key", "left").withColumn("raw", F.coalesce("held", "raw"))
    told = written(answer_errors(told), "told")
    require_none(told.filter("error is not null").select("id", "error"), "answers that don't keep their contract", JudgeError)
    judged = told.select(*pairs.columns, "answer.verdict", "answer.rationale", "answer.confidence", "answer.left_sql_quote", "answer.right_sql_quote")
    totals = usage_totals(asked, used).first().asDict()
    return judged, told.select("key", "raw"), totals


def drift_findings(judged: DataFrame) -> DataFrame:
    """One finding for each metric with drifted pairs."""
    drifted = judged.filter("verdict = 'drifted'")
    source = F.when(F.col("match_kind") == "same_column_name", "dbt_sql").otherwise("dashboard_metadata")
    quote = lambda s: F.struct(source.alias("source"), F.concat(F.lit("semantic://"), "id", F.lit(f"/{s}")).alias("uri"), F.concat(F.lit("candidate="), "id", F.lit(f"/side={s}")).alias("locator"), F.lit(None).cast("string").alias("content_hash"), F.col(f"{s}_sql_quote").alias("excerpt"))
    own = drifted.withColumn("pointers", F.concat("evidence", F.array(quote("left"), quote("right"))))
    each = own.groupBy("metric_name").agg(F.sort_array(F.collect_list(F.struct("id", "left_asset_id", "right_asset_id", "pointers"))).alias("c"), F.min("confidence").alias("least"))
    assets = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda x: F.array(x["left_asset_id"], x["right_asset_id"])))))
    digest = F.substring(F.sha2(F.array_join(F.transform("c", lambda x: x["id"]), "|"), 256), 1, 12)
    evidence = arrays.distinct_structs(F.flatten(F.transform("c", lambda x: x["pointers"])))
    return findings(each, "metric_definition_conflict", F.concat_ws(":", F.lit("metric_definition_conflict"), "metric_name", digest), F.concat(F.lit("Metric "), "metric_name", F.lit(" has definitions that don't agree.")), assets, evidence, F.col("least"), "semantic_llm")
