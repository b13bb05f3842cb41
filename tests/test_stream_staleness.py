"""Staleness on a stream equals the batch result after replay; declared tables are read by tasks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from estatelens.operators import usage
from estatelens.sources import project
from estatelens.sources.declared import DeclaredTables
from estatelens.streaming import last_use

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "board string, at timestamp"


def at(days, us=0):
    return DAY + dt.timedelta(days=days, microseconds=us)


def test_equals_batch_after_replay(spark, tmp_path):
    """One file a batch: rows out of order within the bound, keys used again, rows on the limit and one microsecond off, nulls, repeats, a row that the bound drops."""
    batches = [
        [("quiet", at(0)), ("back", at(0)), ("edge", at(69)), ("off", at(69, 1)), (None, at(1)), ("no time", None)],
        [("busy", at(60)), ("quiet", at(58)), ("quiet", at(58))],
        [("busy", at(140)), ("swap", at(90))],
        [("back", at(150)), ("quiet", at(139))],
        [("busy", at(201))],
        [("older than the bound", at(188))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = last_use.replay(spark, log, ["board"], "at", 120, "12 days", f"{tmp_path}/kept")
        seen = [r for b in batches[: i + 1] for r in b if None not in r and r[0] != "older than the bound"]
        as_of = max(t for _, t in seen) - dt.timedelta(days=12)
        want = usage.stale(spark.createDataFrame(seen, SCHEMA), ["board"], "at", as_of, 120)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), i
    notices = spark.read.parquet(f"{tmp_path}/kept/notices").filter("board = 'back'").orderBy("last_used")
    assert [(r.last_used, r.is_stale) for r in notices.collect()] == [(at(0), True), (at(150), False)]


def test_newest_rows_before_the_shuffle(spark):
    log = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("at"))
    rows = last_use.newest_rows(log, ["k"], "at")
    assert rows.count() < 100 and rows.groupBy("k").agg(F.max("at").alias("m")).exceptAll(log.groupBy("k").agg(F.max("at").alias("m"))).isEmpty()


def test_newest_rows_of_many_keys(spark):
    """A task of many Arrow batches sends a row for each key, not for each key and batch."""
    log = spark.range(0, 200_000, 1, 2).select((F.col("id") % 5000).alias("k"), F.timestamp_seconds("id").alias("at"))
    rows = last_use.newest_rows(log, ["k"], "at")
    assert rows.count() <= 10_000 and rows.groupBy("k").agg(F.max("at").alias("m")).exceptAll(log.groupBy("k").agg(F.max("at").alias("m"))).isEmpty()


def test_keys_of_one_bucket(spark, tmp_path, monkeypatch):
    """Keys share state and timer: each becomes stale in its own time, and is withdrawn, whatever the others do; two key columns, NaN among them."""
    monkeypatch.setattr(last_use, "BUCKETS", 1)
    monkeypatch.setattr(last_use, "HELD_ROWS", 4)
    schema = "board string, part double, at timestamp"
    nan = float("nan")
    batches = [
        [("a", nan, at(0)), ("a", 1.0, at(3)), ("b", nan, at(40)), ("b", 1.0, at(41)), ("c", 0.0, at(60))],
        [("d", 1.0, at(130))],
        [("a", nan, at(140)), ("d", 1.0, at(165)), ("a", nan, at(139))],
        [("e", 1.0, at(290))],
        [("b", 1.0, at(300)), ("b", 1.0, at(301)), ("f", 1.0, at(320))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = last_use.replay(spark, log, ["board", "part"], "at", 120, "30 days", f"{tmp_path}/kept")
        seen = [r for b in batches[: i + 1] for r in b]
        want = usage.stale(spark.createDataFrame(seen, schema), ["board", "part"], "at", max(r[2] for r in seen) - dt.timedelta(days=30), 120)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), i


def test_declared_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_hidden.yml").write_text("sources: [7]")
    (tmp_path / "other.yaml").write_text("models: []")
    (tmp_path / "empty.yml").write_text("")
    (tmp_path / "a" / "s.yml").write_text("sources: [{name: grid, database: db, tables: [{name: t, columns: [{name: ' x '}, {name: y}]}, {name: u}]}]")
    spark.dataSource.register(DeclaredTables)
    df = spark.read.format("declared_tables").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = {r.id: r for r in project.load_sources(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.relation_name, r.columns) for k, r in rows.items()} == {"source.grid.t": ("db.grid.t", ["x", "y"]), "source.grid.u": ("db.grid.u", [])}
    assert rows["source.grid.t"].path == f"file:{tmp_path}/a/s.yml" and rows["source.grid.t"].evidence[0].locator == "source=grid.t"


@pytest.mark.parametrize("body, message", [
    ("sources: [{name: g, tables: [{name: t, colour: red}]}]", "expected the fields"),
    ("sources: [{tables: []}]", "expected the fields"),
    ("sources: [{name: g, tables: [{name: t, columns: [{name: a}, {name: ' a'}]}]}]", "declares a column twice"),
    ("sources: [{name: g, tables: [{name: t}, {name: t}]}]", "declared twice"),
    ("sources: [", "not YAML"),
    ("sources: []\nextra: 1", "expected the fields"),
])
def test_bad_declarations(spark, tmp_path, body, message):
    (tmp_path / "s.yml").write_text(body)
    with pytest.raises(project.ProjectError, match=message):
        project.load_sources(spark, str(tmp_path))


def test_no_declarations(spark, tmp_path):
    assert project.load_sources(spark, str(tmp_path)).count() == 0
