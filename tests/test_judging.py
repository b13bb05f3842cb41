"""Judge calls made by tasks: each key once, kept by waves, repeated only where they were lost."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from estatelens.plans import definitions


class Clerk:
    """Answers, leaves a file for each call, and refuses what its folder says."""

    name, model, usage = "clerk", "m", (3, 1)

    def __init__(self, folder):
        self.folder = str(folder)

    def complete(self, prompt):
        which = prompt.split("candidate_id (", 1)[1].split(")", 1)[0]
        open(f"{self.folder}/call-{which}-{uuid.uuid4().hex}", "w").close()
        if os.path.exists(f"{self.folder}/refuse-{which}"):
            raise definitions.JudgeError(f"no answer for {which}")
        return json.dumps({"candidate_id": which, "verdict": "drifted", "rationale": "r", "left_sql_quote": "l", "right_sql_quote": "r", "confidence": 0.5})


def calls(folder):
    return sorted(f.split("-")[1] for f in os.listdir(folder) if f.startswith("call-"))


def test_calls_in_tasks(spark, tmp_path):
    ids = [f"c{i}" for i in range(10)]
    pairs = spark.createDataFrame([(i, "m", "a", "b", f"select l{i}", f"select r{i}") for i in [*ids, "c3"]], "id string, metric_name string, left_asset_id string, right_asset_id string, left_sql string, right_sql string")
    path, clerk = f"file://{tmp_path}/cache", Clerk(tmp_path)
    asked = definitions.with_cached(pairs, None, "clerk", "m")
    order = [r.id for r in asked.select("id", "key").distinct().orderBy("key").collect()]
    keep = lambda answers: definitions.save_answers(answers, path)
    (tmp_path / f"refuse-{order[5]}").touch()
    with pytest.raises(definitions.JudgeError, match="refused"):
        definitions.asked_in_tasks(asked, clerk, 2, keep, calls=2)
    # two waves of four went out; of the second all but the refused call are kept
    assert calls(tmp_path) == sorted(order[:8]) and definitions.load_cache(spark, path).count() == 7
    (tmp_path / f"refuse-{order[5]}").unlink()
    held = definitions.with_cached(pairs, definitions.load_cache(spark, path), "clerk", "m")
    got = definitions.asked_in_tasks(held, clerk, 2, keep, calls=2)
    assert got.agg(F.count("raw"), F.sum("prompt_tokens")).first() == (3, 9)
    assert calls(tmp_path) == sorted([*ids, order[5]]) and definitions.load_cache(spark, path).count() == 10
    judged, answers, totals = definitions.judge_with(pairs, clerk, definitions.load_cache(spark, path), tasks=2, keep=keep)
    assert judged.count() == answers.count() == 11 and totals["requests"] == 0 and totals["cache_hits"] == 11 and len(calls(tmp_path)) == 11
    with pytest.raises(ValueError, match="1 or more"):
        definitions.asked_in_tasks(asked, clerk, 0)
