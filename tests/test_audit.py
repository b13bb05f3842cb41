"""The demonstration estate end to end: planted defects are found, look-alikes aren't, runs repeat."""

import json

import pytest
from pyspark.sql import functions as F

from estatelens import cli, schemas
from estatelens.plans import audit, dag, definitions, lineage, provider, scoring, sqltext, verify
from estatelens.sources import dashboards, fixture, project, querylog


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("estate")
    fixture.generate(spark, str(path))
    return path


@pytest.fixture(scope="module")
def estate(spark, root):
    return fixture.load(spark, str(root))


@pytest.fixture(scope="module")
def audited(spark, estate):
    return audit.run_audit(spark, estate)


def test_all_defects_and_no_lookalike(spark, root, audited, tmp_path):
    path = str(tmp_path / "out" / "audit.json")
    audit.write_findings(audited[0], path)
    found = audit.load_findings(spark, f"file://{path}")
    card = scoring.score(found, scoring.load_manifest(spark, f"file://{root}/manifest.yaml"))
    assert card.recall == 1 and card.flagged_negative_ids == [] and card.unmatched_finding_ids == [] and card.finding_count == 7
    assert [d["finding_id"] for d in card.per_defect][:4] == ["unused_column_propagation:panel_sheet", "orphaned_model:clean_cards", "broken_lineage:model.clean_members.iban_tail", card.per_defect[3]["finding_id"]]
    assert audit.as_json(found) == audit.as_json(audited[0])


def test_build_summary(estate):
    got = audit.build_summary(estate)
    assert (got["nodes"], got["edges"]) == (73, 70)
    assert got["nodes_by_layer"] == {"source": 10, "staging": 10, "intermediate": 10, "marts": 10, "tile": 33} and got["models_by_layer"] == {"staging": 10, "intermediate": 10, "marts": 10}
    assert {u["reason_code"] for u in got["unresolved"]} == {"missing_upstream_column", "row_level_aggregation"}
    assert got["findings"] == ["broken_lineage:model.clean_members.iban_tail", "orphaned_model:clean_cards", "unused_column_propagation:panel_sheet"]
    assert got["graph_fingerprint"] == dag.fingerprint(estate.nodes.orderBy(F.desc("id")), estate.edges.repartition(3)).first()[0] != dag.fingerprint(estate.nodes, estate.edges.limit(3)).first()[0]


def test_lineage_fingerprint(estate):
    own = estate.lineage
    same = lineage.Lineage(own.columns.orderBy(F.desc("id")), own.edges.repartition(3), own.unresolved, {})
    other = lineage.Lineage(own.columns, own.edges.orderBy("source_id").limit(5), own.unresolved, {})
    value = lineage.fingerprint(own).first()[0]
    assert value == lineage.fingerprint(same).first()[0] != lineage.fingerprint(other).first()[0]


def test_lineage_paths(estate):
    own = estate.lineage
    assert lineage.source_columns_for(own, "column.tile.control_room.control_room_surplus.surplus") == ["column.source.grid.readings.kwh_in", "column.source.grid.readings.kwh_out"]
    # a subset of what a mean is made of
    assert {"column.source.grid.readings.kwh_out"} <= set(lineage.source_columns_for(own, "column.tile.villages.villages_yield.mean_fed"))
    broken = lineage.unresolved_for(own, "column.tile.share_register.share_register_account.iban_tail").collect()
    assert [r.reason_code for r in broken] == ["missing_upstream_column"]
    with pytest.raises(KeyError):
        lineage.source_columns_for(own, "column.none")


@pytest.mark.parametrize(
    ("sql", "columns", "sources", "reasons"),
    [
        ("select a + b as c, a from db.t", ["c", "a"], {"c": {"a", "b"}, "a": {"a"}}, []),
        ("select * from db.t where zz > 1", ["a", "b"], {"a": {"a"}, "b": {"b"}}, []),
        ("with x as (select a as p from db.t), y as (select p from x) select y.p, x.p as q from y cross join x", ["p", "q"], {"p": {"a"}, "q": {"a"}}, []),
        ("select a from db.t union all select k from db.u", ["a"], {"a": {"a", "k"}}, []),
        ("select sum(a) over (partition by b) as s from db.t", ["s"], {"s": {"a", "b"}}, []),
        ("select (select max(k) from db.u) as m from db.t", ["m"], {"m": {"k"}}, []),
        ("select t.a, u.v from db.t t join db.u u on t.a = u.k", ["a", "v"], {"a": {"a"}, "v": {"v"}}, []),
        ("select count(*) as n, 1 as one from db.t", ["n", "one"], {}, ["row_level_aggregation", "unsupported_construct"]),
        ("select t.nope as x from db.t", ["x"], {}, ["missing_upstream_column"]),
        ("select nope as x from db.t join db.u on a = k", ["x"], {}, ["ambiguous_column"]),
        ("select x from db.unknown", ["x"], {}, ["unknown_upstream_relation"]),
        ("selectt nonsense (", ["unparsed_output"], {}, ["parse_error"]),
    ],
)
def test_extract(spark, sql, columns, sources, reasons):
    catalog = lineage.Catalog()
    catalog.add("db.t", ["a", "b"], "model.t", [])
    catalog.add("db.u", ["k", "v"], "model.u", [])
    got = lineage.extract(spark, sql, catalog)
    assert [c[0] for c in got.columns] == columns
    assert {k: {c for _, c in v} for k, v in got.sources.items() if v} == sources
    assert [u[3] for u in got.unresolved] == reasons


MISSING = "missing_upstream_column"


@pytest.mark.parametrize(
    ("sql", "sources", "unresolved"),
    [
        ("with c as (select a, b from db.t) select c.a, c.nope from c", {"a": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        ("with c as (select a, b from db.t) select a, nope from c", {"a": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        ("select d.a, d.nope from (select a, b from db.t) d", {"a": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        ("with c as (select a from db.t), d as (select k from db.u) select c.a, d.zzz, d.k from c join d on c.a = d.k", {"a": {"a"}, "k": {"k"}}, {("zzz", "db.u", "zzz", MISSING)}),
        ("with c as (select a, nope from db.t) select a, nope as x from c", {"a": {"a"}}, {("x", "db.t", "nope", MISSING)}),
        # through a star, a chain, a union, groups and DISTINCT
        ("with c as (select * from db.t) select a, nope from c", {"a": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        ("with c as (select a from db.t), d as (select a, nope from c) select a, nope from d x", {"a": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        ("with c as (select a from db.t union all select k from db.u) select a, nope from c", {"a": {"a", "k"}}, {("nope", "c", "nope", MISSING)}),
        ("select s, nope from (select b, (sum(a)) as s from db.t group by 1 order by 1 limit 3) /* ) */ q", {"s": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        ("select a, nope from (select distinct a from db.t where ')' <> b) q where nope > 1", {"a": {"a"}}, {("nope", "db.t", "nope", MISSING)}),
        # the relation has the column, what stands between leaves it out
        ("with c as (select a from db.t) select a, b from c", {"a": {"a"}}, {("b", "c", "b", MISSING)}),
        ("with c(x) as (select a from db.t) select x, a from c", {"x": {"a"}}, {("a", "c", "a", MISSING)}),
        # not missing: aliases, correlation, fields of names, functions without parentheses
        ("with c as (select a as p, b from db.t) select p + 1 as q, q * 2 as r, current_date as now from c where exists (select 1 from db.u where k = p) order by b", {"q": {"a"}, "r": {"a"}}, {("now", None, None, "unsupported_construct")}),
        ("select a, e from db.t lateral view explode(split(b, ',')) x as e", {"a": {"a"}, "e": {"b"}}, set()),
        # only where it reaches an output is it an edge
        ("with c as (select a from db.t) select a from c where c.nope = 1", {"a": {"a"}}, set()),
        ("select a from db.t join db.u using (zz)", {"a": {"a"}}, set()),
        ("with c as (select x from db.gone) select x, y from c", {}, {("x", "db.gone", "x", "unknown_upstream_relation"), ("y", "db.gone", "y", "unknown_upstream_relation")}),
        ("select count(*) as x, count(1) as y from db.t", {}, {("x", None, None, "row_level_aggregation"), ("y", None, None, "unsupported_construct")}),
        ("select count(1) as y /* count(*) */ from db.t", {}, {("y", None, None, "unsupported_construct")}),
        ("select count( * ) as y, 1 + COUNT(/* all */ *) as z from db.t", {}, {("y", None, None, "row_level_aggregation"), ("z", None, None, "row_level_aggregation")}),
        ("with c as (select count(*) as n from db.t) select n, n + 1 as m from c", {}, {("n", None, None, "row_level_aggregation"), ("m", None, None, "row_level_aggregation")}),
    ],
)
def test_missing_columns_of_inner_scopes(spark, sql, sources, unresolved):
    catalog = lineage.Catalog()
    catalog.add("db.t", ["a", "b"], "model.t", [])
    catalog.add("db.u", ["k", "v"], "model.u", [])
    got = lineage.extract(spark, sql, catalog)
    assert {k: {c for _, c in v} for k, v in got.sources.items() if v} == sources
    assert {u[:4] for u in got.unresolved} == unresolved


def test_default_catalog_and_many_missing_columns(spark):
    catalog = lineage.Catalog()
    catalog.add("plant.grid.t", ["a"], "source.t", [])
    catalog.add("analytics.m", ["b"], "model.m", [])
    for name in ("grid.t", "Plant.Grid.T", "plant.grid.t"):
        got = lineage.extract(spark, f"select a from {name}", catalog)
        assert got.sources["a"] == {("plant.grid.t", "a")} and not got.unresolved, name
    assert lineage.extract(spark, "select b from plant.analytics.m", catalog).sources["b"] == {("analytics.m", "b")}
    wide = "select " + ", ".join(f"x{i}" for i in range(30)) + " from grid.t"
    assert [u[3] for u in lineage.extract(spark, wide, catalog).unresolved] == ["missing_upstream_column"] * 30
    catalog.add("other.grid.u", ["a"], "source.u", [])
    assert [u[3] for u in lineage.extract(spark, "select a from grid.t", catalog).unresolved] == ["unknown_upstream_relation"]


def test_star_and_aggregate_outputs(spark):
    catalog = lineage.Catalog()
    catalog.add("db.t", ["a", "b"], "model.t", [])
    got = lineage.extract(spark, "select *, a as again from db.t", catalog)
    assert [(n, star) for n, star, _ in got.columns] == [("a", True), ("b", True), ("again", False)]
    assert lineage.extract(spark, "with x as (select b, sum(a) as total from db.t group by 1) select total, b from x", catalog).aggregates == {"total"}


def test_relations_and_canonical_sql(spark):
    sql = "with c as (select * from A.b) select * from c join d.e.f on true where x in (select y from g.h)"
    assert [r.name for r in sqltext.relations(spark, sql)] == ["A.b", "d.e.f", "g.h"]
    assert sqltext.canonical_sql(spark, "select a frm (") == "select a frm ("


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [
        ("SELECT  a FROM t -- x", "select a\nfrom t", True),
        ("select a from t", "select b from t", False),
        ("select 1 as x", "select '1' as x", False),
        ("select 1 as x", "select 1.0 as x", False),
        ("select a from t where b in ('1')", "select a from t where b in (1)", False),
        ("select '#12' as a from t", "select '#13' as a from t", False),
        ("select a x, (b) from t", "SELECT a AS X, b FROM T", True),
        ("select a from t where b <> 1", "select a from t where b != 1", True),
        ("select a from t where b > interval '7' day", "select a from t where b > interval '8' day", False),
        ("select cast(a as int) from t", "select cast(a as bigint) from t", False),
        ("select a from t join u using (k)", "select a from t inner join u using (k)", True),
        ("select a from t join u using (k)", "select a from t left join u using (k)", False),
        ("select a from t limit 1", "select a from t limit 2", False),
        ("select sum(a) over (partition by b) from t", "select sum(a) over (partition by c) from t", False),
        ("with c as (select 1 as q) select q from c", "with c as (select '1' as q) select q from c", False),
        ("select case when a then 1 end from t", "select case when a then 1 else 0 end from t", False),
        ("select " + ", ".join(f"c{i} as d{i}" for i in range(40)) + ", x from t", "select " + ", ".join(f"c{i} as d{i}" for i in range(40)) + ", y from t", False),
        ("select a from t where exists (select 1 from u where u.k = t.k)", "select a from t where exists (select 1 from u where u.k = t.j)", False),
        ("select a from t where exists (select 1 from u)", "select  a from t where exists (select 1 from u) -- y", True),
    ],
)
def test_canonical_sql(spark, left, right, same):
    assert (sqltext.canonical_sql(spark, left) == sqltext.canonical_sql(spark, right)) == same


def test_log_contract(spark, root, estate, tmp_path):
    log = querylog.load_query_log(spark, f"file://{root}/query_log.parquet")
    usage = {(r.dashboard_id, r.tile_id): (r.last_queried_at.isoformat(), r.query_count_90d) for r in querylog.usage_summaries(log, estate.as_of).collect()}
    assert usage["solar_fair", "solar_fair_capacity"] == ("2025-11-08T09:11:00", 0) and usage["statutes", "statutes_members"][1] == 1
    totals = querylog.log_totals(log).first()
    assert totals.log_rows == log.count() > 1000 and totals.last_at <= estate.as_of and querylog.of_dashboard(log, "statutes").count() == 4
    blank = log.limit(3).withColumn("user", F.lit(" ")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    blank.write.parquet(f"{tmp_path}/blank")
    with pytest.raises(querylog.QueryLogError, match="without a key"):
        querylog.load_query_log(spark, f"{tmp_path}/blank")
    assert querylog.with_evidence(log, "x").filter("length(evidence.content_hash) <> 64").count() == 0
    log.select("dashboard_id", "tile_id", "user").write.parquet(f"{tmp_path}/three")
    with pytest.raises(querylog.QueryLogError):
        querylog.load_query_log(spark, f"{tmp_path}/three")
    with pytest.raises(ValueError):
        querylog.usage_summaries(log.limit(0))


def test_strict_inputs(spark, root, tmp_path):
    bad = fixture.dashboards()
    bad["dashboards"][0]["tiles"][0]["colour"] = "red"
    (tmp_path / "d.json").write_text(json.dumps(bad))
    with pytest.raises(dashboards.DashboardError, match="colour"):
        dashboards.load_dashboards(spark, f"file://{tmp_path}/d.json")
    for where, name in (("title", "title"), ("metric_label", "label")):
        bad = fixture.dashboards()
        bad["dashboards"][0]["tiles"][0][where] = "  "
        (tmp_path / "d.json").write_text(json.dumps(bad))
        with pytest.raises(dashboards.DashboardError, match=name):
            dashboards.load_dashboards(spark, f"file://{tmp_path}/d.json")
    fixture.generate(spark, str(tmp_path))
    model = tmp_path / "project/models/staging/clean_meters.sql"
    good = model.read_text()
    for body in ("select {{ var('x') }} as a", "select * from {{ ref('missing') }}", "select * from {{ source('grid', 'missing') }}"):
        model.write_text(body)
        with pytest.raises(project.ProjectError):
            project.load_project(spark, f"file://{tmp_path}/project")
    model.write_text(good)
    models, _ = project.load_project(spark, f"file://{tmp_path}/project", database="db")
    row = models.filter("name = 'metered_sites'").first()
    assert (row.layer, row.materialization, row.relation_name, sorted(row.refs)) == ("intermediate", "ephemeral", "db.analytics.metered_sites", ["clean_meters", "clean_sites"]) and "{{" not in row.resolved_sql


def test_generate_repeats(spark, root, tmp_path):
    first = fixture.generate(spark, str(tmp_path))
    assert first == fixture.generate(spark, str(tmp_path)) and "query_log.parquet" in first and len(first) == 30 + 5
    boards = fixture.dashboards()["dashboards"]
    assert (len(fixture.MODELS), len(fixture.TABLES), len(boards), sum(len(b["tiles"]) for b in boards)) == (30, 10, 12, 33)


def test_generate_verifies(spark, tmp_path, monkeypatch):
    """An estate without one of its planted cases isn't accepted."""
    monkeypatch.setitem(fixture.MODELS, "staging/clean_members", fixture.MODELS["staging/clean_members"].replace(", iban_tail", ", village as iban_tail"))
    with pytest.raises(AssertionError, match="account-tail"):
        fixture.generate(spark, str(tmp_path))


def test_contract_violations(spark):
    edges = spark.createDataFrame([("a", "a", "model_dependency", [("s", "u", "l", None, None)]), ("a", "b", "model_dependency", []), ("a", "b", "other", [("s", "u", "l", None, None)]), ("a", "b", "tile_dependency", [("s", "u", "l", None, None)])], schemas.EDGES)
    assert schemas.edge_violations(edges).count() == 3
    e = [("s", "u", "l", None, None)]
    findings = spark.createDataFrame([("i", "stale_asset", "", ["a"], e, 1.5, "deterministic"), ("i", "stale_asset", "", ["a"], e, 1.0, "semantic_llm"), ("i", "stale_asset", "", [], e, 1.0, "deterministic"), ("i", "stale_asset", "", ["a"], e, 1.0, "deterministic")], schemas.FINDINGS)
    assert schemas.finding_violations(findings).count() == 3


class Parrot:
    name, model, asked, usage = "parrot", "m1", 0, (7, 2)

    def complete(self, prompt):
        self.asked += 1
        side = lambda s: prompt.split(f"\n{s} ", 1)[1].split(":\n", 1)[1].split("\nRIGHT " if s == "LEFT" else "\nAnswer as", 1)[0]
        return json.dumps({"candidate_id": prompt.split("candidate_id (", 1)[1].split(")", 1)[0], "verdict": "drifted" if "total_revenue" in prompt or "quiet_meters" in prompt else "unrelated", "rationale": "r", "left_sql_quote": side("LEFT"), "right_sql_quote": side("RIGHT"), "confidence": 0.5})


def test_provider_and_saved_cache(spark, estate, audited, tmp_path):
    parrot, path, said = Parrot(), f"file://{tmp_path}/cache", []
    _, judged, totals = audit.run_audit(spark, estate, parrot, path, said.append)
    assert totals == {"requests": 9, "cache_hits": 0, "prompt_tokens": 63, "completion_tokens": 18, "cost": 0.0} and parrot.asked == 9 and judged.filter("verdict = 'drifted'").count() == 2
    assert sum(x.startswith("judged ") for x in said) == 9
    findings, _, totals = audit.run_audit(spark, estate, parrot, path)
    assert (totals["requests"], totals["cache_hits"], totals["prompt_tokens"]) == (0, 9, 0) and parrot.asked == 9
    assert sorted(r.id for r in findings.collect()) == sorted(r.id for r in audited[0].collect()) and definitions.load_cache(spark, path).count() == 9
    assert audited[2] == {"requests": 0, "cache_hits": judged.count(), "prompt_tokens": 0, "completion_tokens": 0, "cost": 0.0}
    # held answers are checked like new ones
    pairs = audited[1].select("id", "match_kind", "metric_name", "left_asset_id", "right_asset_id", "left_sql", "right_sql", "left_primary", "right_primary", "evidence")
    spoilt = definitions.load_cache(spark, path).withColumn("raw", F.replace("raw", F.lit("drifted"), F.lit("perhaps")))
    with pytest.raises(definitions.JudgeError, match="unknown verdict"):
        definitions.judge_with(pairs, parrot, spoilt)
    spark.range(2).write.parquet(f"{tmp_path}/other")
    with pytest.raises(definitions.JudgeError, match="not a cache"):
        definitions.load_cache(spark, f"file://{tmp_path}/other")
    assert definitions.load_cache(spark, f"file://{tmp_path}/none") is None


def test_answers(spark, audited):
    pair = audited[1].first().asDict()
    good = json.loads(Parrot().complete(definitions.prompt(pair)))
    cases = [(json.dumps(good), None), ("not json", "not JSON"), (None, "not JSON"), ("[1]", "not the fields"), (json.dumps(good | {"extra": 1}), "not the fields"), (json.dumps(good | {"rationale": 3}), "not the fields"), (json.dumps(good | {"left_sql_quote": "invented"}), "a quote"), (json.dumps(good | {"verdict": "maybe"}), "another candidate"), (json.dumps(good | {"confidence": -1}), "another candidate"), (json.dumps(good | {"candidate_id": "x"}), "another candidate"), (json.dumps(good | {"left_sql_quote": ""}), "a quote")]
    rows = spark.createDataFrame([(i, pair["id"], pair["left_sql"], pair["right_sql"], raw) for i, (raw, _) in enumerate(cases)], "i int, id string, left_sql string, right_sql string, raw string")
    got = [r.error for r in definitions.answer_errors(rows).orderBy("i").collect()]
    assert all(g is None if want is None else want in g for g, (_, want) in zip(got, cases, strict=True)), got


def test_every_planted_case_is_read(spark, root, estate):
    got = verify.verify(spark, estate, f"file://{root}/manifest.yaml").collect()
    assert len(got) == 13 and all(r.passed for r in got), got


def test_verification_names_what_is_wrong(spark, root, estate, tmp_path):
    """A manifest that names other models for its cases fails there, and only there."""
    text = (root / "manifest.yaml").read_text().replace("model=clean_members", "model=clean_sites").replace("model=panel_sheet", "model=phase_census")
    (tmp_path / "manifest.yaml").write_text(text)
    got = {r.id: r.passed for r in verify.verify(spark, estate, f"file://{tmp_path}/manifest.yaml").collect()}
    assert {i for i, ok in got.items() if not ok} == {"account-tail", "panel-star"}


def test_chat_provider_asks_for_fixed_fields(monkeypatch):
    monkeypatch.delenv("ESTATELENS_API_KEY", raising=False)
    with pytest.raises(definitions.JudgeError):
        provider.ChatProvider("m", "http://localhost:1/none")
    chat = provider.ChatProvider("m", "http://127.0.0.1:9/none", "key", timeout=1)
    schema = chat.body("p")["response_format"]["json_schema"]["schema"]
    assert chat.body("p")["temperature"] == 0 and not schema["additionalProperties"] and schema["required"] == list(provider.PROPERTIES)
    with pytest.raises(definitions.JudgeError):
        chat.complete("p")


def test_chat_provider_reads_replies(monkeypatch):
    chat = provider.ChatProvider("m", "http://127.0.0.1:9/none", "key")
    monkeypatch.setattr(chat, "_post", lambda body: {"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}})
    assert chat.complete("p") == "x" and chat.usage == (5, 1) and "key" not in repr(chat)
    monkeypatch.setattr(chat, "_post", lambda body: {"choices": []})
    with pytest.raises(definitions.JudgeError, match="no answer"):
        chat.complete("p")


def test_export_and_page(estate, audited):
    export = audit.graph_export(estate, audited[0])
    by = {n["id"]: n["findings"] for n in export["nodes"]}
    assert len(export["nodes"]) == 73 and by["tile.solar_fair.solar_fair_capacity"] == ["stale_asset:solar_fair"] and by["model.panel_sheet"] == ["unused_column_propagation:panel_sheet"]
    assert export["legend"] == {"metric_definition_conflict": 2, "duplicate_dashboard": 1, "stale_asset": 1, "orphaned_model": 1, "broken_lineage": 1, "unused_column_propagation": 1}
    at = audit.placed(export)
    assert len(set(at.values())) == 73 and {c for c, _ in at.values()} == set(range(5))
    export["nodes"][0]["label"] = "</script><b>"
    page = audit.render_html(export)
    assert page.count("</script>") == 2 and "panel_sheet" in page and "legend" in page and 'id="search"' in page and 'id="detail"' in page


def test_materialized_models(spark):
    from estatelens.plans import materialize

    rows = [("a", "view", "x.a", "select k + 1 as k from raw.t", []), ("b", "table", "x.b", "select k * 10 as k from X.A where k > 1", ["a"]), ("c", "ephemeral", "x.c", "select max(k) as k from x.b", ["b"])]
    models = spark.createDataFrame(rows, "name string, materialization string, relation_name string, resolved_sql string, refs array<string>")
    got = materialize.run_models(spark, models, {"plant.raw.t": spark.range(3).withColumnRenamed("id", "k")})
    assert sorted(got) == ["x.a", "x.b", "x.c"] and got["x.c"].first().k == 30 and got["x.b"].inputFiles() and not got["x.a"].inputFiles()
    with pytest.raises(ValueError, match="no relation"):
        materialize.run_models(spark, models, {})


def test_command_line(root, tmp_path, capsys):
    assert cli.main(["ask"]) == 2
    out = str(tmp_path / "audit.json")
    assert cli.main(["audit", "--root", str(root), "--out", out]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["findings"] == 7 and "candidates" in said.err
    assert cli.main(["eval", "--root", str(root), "--out", out]) == 0 and cli.main(["verify", "--root", str(root)]) == 0
    with pytest.raises(definitions.JudgeError):
        cli.main(["audit", "--root", str(root), "--backend", "chat", "--model", "m", "--url", "http://127.0.0.1:9/none"])
