"""A demonstration estate of our own: an energy cooperative's analytics project, dashboards and query log.

Every case that the checks know is planted once, with a look-alike for each kind of finding
that has a usual false alarm; MANIFEST names both. Nothing is drawn at random, so two runs
write the same files. The query log follows an office calendar: desks read their dashboards on
their own weekdays, more often at the turn of a month, and nobody reads on the days off.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .querylog import write_query_log

AS_OF = dt.datetime(2026, 4, 30, 18, 0, 0)
SEED = 2026
PROJECT = "cooperative"
TABLES = {
    "meters": ["meter_no", "site_no", "phase_count", "installed_on", "firmware"],
    "sites": ["site_no", "member_no", "postcode", "feeder", "roof_area", "storey_count"],
    "members": ["member_no", "entered_on", "share_count", "village"],
    "readings": ["meter_no", "read_at", "kwh_in", "kwh_out", "quality_flag"],
    "tariffs": ["tariff_code", "valid_from", "valid_to", "cent_per_kwh", "standing_cent", "green_share"],
    "contracts": ["contract_no", "site_no", "tariff_code", "begins_on", "ends_on"],
    "invoices": ["invoice_no", "contract_no", "billed_on", "energy_cent", "standing_cent", "refund_cent", "vat_cent", "dunning_level"],
    "outages": ["outage_no", "feeder", "began_at", "ended_at", "cause"],
    "panels": ["panel_no", "site_no", "peak_watt", "tilt", "azimuth", "inverter", "string_no", "commissioned_on", "warranty_years", "vendor", "serial", "cleaned_on", "shade_index", "monitoring_key"],
    "paper_readings": ["card_no", "meter_label", "dial", "noted_on"],
}


def _pick(table: str, *columns: str, where: str = "") -> str:
    return f"select {', '.join(columns or TABLES[table])}\nfrom {{{{ source('grid', '{table}') }}}}" + (f"\nwhere {where}" if where else "")


def _ref(name: str) -> str:
    return f"{{{{ ref('{name}') }}}}"


STAGING = {
    "clean_meters": _pick("meters"),
    "clean_sites": _pick("sites", "site_no", "member_no", "postcode", "feeder"),
    "clean_members": _pick("members", "member_no", "entered_on", "share_count", "village", "iban_tail"),  # planted: members has no iban_tail
    "clean_readings": _pick("readings", where="quality_flag <> 'E'"),
    "clean_tariffs": _pick("tariffs"),
    "clean_contracts": _pick("contracts"),
    "clean_invoices": _pick("invoices", "invoice_no", "contract_no", "billed_on", "energy_cent", "standing_cent", "coalesce(refund_cent, 0) as refund_cent", "vat_cent", "dunning_level"),
    "clean_outages": _pick("outages"),
    "clean_panels": _pick("panels"),
    "clean_cards": _pick("paper_readings"),  # planted: nobody reads it
}
INTERMEDIATE = {
    "hourly_flow": f"select meter_no, date_trunc('hour', read_at) as hour, sum(kwh_in) as drawn, sum(kwh_out) as fed\nfrom {_ref('clean_readings')}\ngroup by 1, 2",
    "daily_flow": f"select meter_no, cast(hour as date) as day, sum(drawn) as drawn, sum(fed) as fed\nfrom {_ref('hourly_flow')}\ngroup by 1, 2",
    "metered_sites": f"select s.site_no, s.member_no, s.feeder, m.meter_no, m.phase_count\nfrom {_ref('clean_sites')} s\nleft join {_ref('clean_meters')} m on m.site_no = s.site_no",
    "site_balance": f"with own as (select site_no, meter_no from {_ref('metered_sites')})\nselect own.site_no, d.day, d.drawn, d.fed, d.fed - d.drawn as surplus\nfrom own join {_ref('daily_flow')} d using (meter_no)",
    "priced_contracts": f"select c.contract_no, c.site_no, c.begins_on, t.cent_per_kwh, t.standing_cent\nfrom {_ref('clean_contracts')} c\njoin {_ref('clean_tariffs')} t using (tariff_code)",
    "billing_lines": f"select i.invoice_no, i.contract_no, p.site_no, i.billed_on, i.energy_cent, i.standing_cent, i.refund_cent, i.dunning_level\nfrom {_ref('clean_invoices')} i\njoin {_ref('priced_contracts')} p on p.contract_no = i.contract_no",
    "panel_sheet": f"-- all that is known of a panel\nselect * from {_ref('clean_panels')}",  # planted: a star of 14 columns, two of them read
    "feeder_downtime": f"select feeder, cast(began_at as date) as day, count(*) as outages, min(began_at) as first_at, max(ended_at) as last_at\nfrom {_ref('clean_outages')}\ngroup by 1, 2",
    "member_register": f"select member_no, share_count, village, iban_tail\nfrom {_ref('clean_members')}",
    "site_owners": f"select s.site_no, s.feeder, r.member_no, r.village\nfrom {_ref('clean_sites')} s\nleft join {_ref('member_register')} r using (member_no)",
}
MARTS = {
    "energy_days": f"select b.day, o.village, sum(b.drawn) as drawn, sum(b.fed) as fed, sum(b.surplus) as surplus, count(distinct b.site_no) as sites\nfrom {_ref('site_balance')} b\njoin {_ref('site_owners')} o using (site_no)\ngroup by 1, 2",
    "bill_items": f"select invoice_no, site_no, billed_on, energy_cent, standing_cent, refund_cent\nfrom {_ref('billing_lines')}",
    "open_claims": f"select invoice_no, billed_on, energy_cent + standing_cent - refund_cent as due_cent\nfrom {_ref('billing_lines')}\nwhere dunning_level > 0",
    "quiet_meters_week": f"select count(distinct meter_no) as quiet_meters\nfrom {_ref('daily_flow')}\nwhere drawn = 0 and day >= current_date - interval '7 days'",  # planted: one name, two windows
    "quiet_meters_quarter": f"select count(distinct meter_no) as quiet_meters\nfrom {_ref('daily_flow')}\nwhere drawn = 0 and day >= current_date - interval '90 days'",
    "panel_capacity": f"with sheet as (select * from {_ref('panel_sheet')})\nselect site_no, sum(peak_watt) as peak_watt, count(*) as panels\nfrom sheet\ngroup by 1",
    "feeder_record": f"select f.feeder, f.day, f.outages, nullif(count(o.site_no), 0) as sites\nfrom {_ref('feeder_downtime')} f\nleft join {_ref('site_owners')} o on o.feeder = f.feeder\ngroup by 1, 2, 3",
    "member_card": f"select member_no, share_count, iban_tail\nfrom {_ref('member_register')}",
    "village_yield": f"with totals as (select village, avg(fed) as mean_fed from {_ref('energy_days')} group by 1), whole as (select avg(fed) as all_fed from {_ref('energy_days')})\nselect totals.*, whole.all_fed\nfrom totals cross join whole",
    "phase_census": f"select phase_count, count(*) as meters\nfrom {_ref('metered_sites')}\ngroup by 1",  # look-alike: few read it, but a tile does
}
MODELS = {f"{layer}/{name}": sql for layer, models in (("staging", STAGING), ("intermediate", INTERMEDIATE), ("marts", MARTS)) for name, sql in models.items()}

_SUPPLY = {  # tiles that the control room's dashboards share
    "drawn": ("Energy drawn", "select day, sum(drawn) as drawn from analytics.energy_days group by 1 order by 1"),
    "fed": ("Energy fed in", "select day, sum(fed) as fed from analytics.energy_days group by 1 order by 1"),
    "surplus": ("Surplus", "select village, sum(surplus) as surplus from analytics.energy_days group by 1"),
    "outages": ("Outages", "select feeder, sum(outages) as outages from analytics.feeder_record group by 1"),
    "peak": ("Peak power", "select sum(peak_watt) as peak_watt from analytics.panel_capacity"),
}


def _board(board: str, title: str, desk: str, tiles: list[tuple[str, str, str]], shared: tuple[str, ...] = ()) -> dict:
    rows = [*[(f"{board}_{k}", *_SUPPLY[k]) for k in shared], *[(f"{board}_{k}", label, sql) for k, label, sql in tiles]]
    return {"id": board, "title": title, "description": f"{title}, kept by the {desk} desk", "tiles": [{"id": i, "title": label, "metric_label": label, "sql": sql} for i, label, sql in rows]}


def dashboards() -> dict:
    bills = "from analytics.bill_items"
    boards = [
        _board("treasury", "Treasury", "accounts", [("income", "Total Revenue", f"select sum(energy_cent + standing_cent) as total_revenue {bills}"), ("gross", "Billed energy", f"select sum(energy_cent) as billed {bills}")]),
        _board("auditors", "Annual accounts", "accounts", [("income", "Total Revenue", f"select sum(energy_cent + standing_cent - refund_cent) as total_revenue {bills}"), ("credited", "Energy less refunds", f"select sum(energy_cent - refund_cent) as billed {bills}")]),
        _board("control_room", "Control room", "grid", [("week", "Quiet meters, week", "select quiet_meters from analytics.quiet_meters_week")], ("drawn", "fed", "surplus", "outages")),
        _board("night_shift", "Night shift", "grid", [("quarter", "Quiet meters, quarter", "select quiet_meters from analytics.quiet_meters_quarter")], ("drawn", "fed", "surplus", "outages")),
        _board("field_crew", "Field crew", "grid", [("claims", "Claims nearby", "select count(*) as claims from analytics.open_claims"), ("sites", "Sites", "select sum(sites) as sites from analytics.energy_days"), ("panels", "Panels", "select sum(panels) as panels from analytics.panel_capacity")], ("outages", "peak")),
        _board("villages", "Villages", "members", [("yield", "Yield", "select village, mean_fed from analytics.village_yield"), ("share", "Share of the mean", "select village, mean_fed / all_fed as share from analytics.village_yield"), ("sunny", "Sunny days", "select village, count(*) as days from analytics.energy_days where fed > drawn group by 1")]),
        _board("share_register", "Share register", "members", [("account", "Account numbers", "select member_no, iban_tail from analytics.member_card"), ("shares", "Shares", "select sum(share_count) as shares from analytics.member_card")]),
        _board("dunning", "Dunning", "accounts", [("due", "Due", "select sum(due_cent) as due from analytics.open_claims"), ("due_again", "Due", "SELECT SUM(due_cent)  AS due\nFROM analytics.open_claims"), ("oldest", "Oldest claim", "select min(billed_on) as oldest from analytics.open_claims")]),
        _board("solar_fair", "Solar fair", "projects", [("capacity", "Capacity", "select count(*) as sites, sum(peak_watt) as peak_watt from analytics.panel_capacity")]),
        _board("census", "Metering census", "projects", [("phases", "Phases", "select phase_count, meters from analytics.phase_census")]),
        _board("statutes", "General meeting", "members", [("members", "Members", "select count(*) as members from analytics.member_card"), ("income", "Billed energy, yearly", f"select date_trunc('year', billed_on) as year, sum(energy_cent) as billed {bills} group by 1")]),
        _board("grid_report", "Report to the regulator", "grid", [("reliability", "Outage days", "select count(distinct day) as outage_days from analytics.feeder_record"), ("sites", "Sites without power", "select feeder, max(sites) as sites from analytics.feeder_record group by 1")]),
    ]
    return {"schema_version": 1, "seed": SEED, "generated_as_of": AS_OF.isoformat() + "Z", "dashboards": boards}


def _at(**place: str) -> str:
    return "/".join(f"{k}={v}" for k, v in place.items())


def _model_file(name: str) -> str:
    return next(f"project/models/{path}.sql" for path in MODELS if path.endswith(f"/{name}"))


def manifest() -> dict:
    """The planted cases and their look-alikes."""
    tile = lambda board, name: {"path": "dashboards.json", "locator": _at(dashboard=board, tile=f"{board}_{name}")}
    board = lambda name: {"path": "dashboards.json", "locator": _at(dashboard=name)}
    model = lambda name: {"path": _model_file(name), "locator": _at(model=name)}
    log = lambda name: {"path": "query_log.parquet", "locator": f"dashboard_id={name}/max(timestamp)"}
    conflict, stale, double, orphan = "metric_definition_conflict", "stale_asset", "duplicate_dashboard", "orphaned_model"
    planted = [
        ("panel star", "unused_column_propagation", "a star passes on columns that nothing reads", [model("panel_sheet")]),
        ("card readings", orphan, "nothing reads the transcribed cards", [model("clean_cards")]),
        ("account tail", "broken_lineage", "the members table holds no account number", [model("clean_members")]),
        ("income", conflict, "the auditors subtract refunds, the treasury doesn't", [tile("treasury", "income"), tile("auditors", "income")]),
        ("quiet meters", conflict, "a week against a quarter", [model("quiet_meters_week"), model("quiet_meters_quarter")]),
        ("two rooms", double, "the night shift has four of the control room's five tiles", [board("control_room"), board("night_shift")]),
        ("fair", stale, "the fair was last year", [log("solar_fair")]),
    ]
    harmless = [
        ("crew", double, "the field crew shares one tile of five", [board("control_room"), board("field_crew")]),
        ("meeting", stale, "read before general meetings only, but within the limit", [log("statutes")]),
        ("census", orphan, "a single tile reads it", [model("phase_census")]),
        ("due", conflict, "one query, written twice", [tile("dunning", "due"), tile("dunning", "due_again")]),
        ("billing", conflict, "two labels for two figures", [tile("treasury", "gross"), tile("auditors", "credited")]),
    ]
    item = lambda expected: lambda row: {"id": row[0].replace(" ", "-"), "expected": expected, "type": row[1], "description": row[2], "locations": row[3]}
    return {"schema_version": 1, "dataset_id": PROJECT, "seed": SEED, "as_of": AS_OF.isoformat() + "Z", "defects": list(map(item("positive"), planted)), "negatives": list(map(item("negative"), harmless))}


# desk: its weekdays (1 Sunday to 7 Saturday), its hour, and how many people read there
DESKS = {"accounts": ([2, 5], 8, 2), "grid": ([2, 3, 4, 5, 6], 6, 3), "members": ([3], 10, 1), "projects": ([4], 14, 1)}
DAYS_OFF = ["2026-01-01", "2026-01-06", "2026-04-03", "2026-04-06"]
LAST_FAIR = "2025-11-08"  # before the limit of 120 days
MEETINGS = ["2026-01-27", "2026-03-10"]


def query_log(spark: SparkSession) -> DataFrame:
    """The rows of four months before AS_OF: a reading of every tile by each reader of its desk on the desk's weekdays, twice from the 28th to the 3rd."""
    boards = [(d["id"], d["description"].removesuffix(" desk").rsplit(" ", 1)[1], t["id"], k) for d in dashboards()["dashboards"] for k, t in enumerate(d["tiles"])]
    tiles = spark.createDataFrame(boards, "dashboard_id string, desk string, tile_id string, k int")
    desks = spark.createDataFrame([(n, *rest) for n, rest in DESKS.items()], "desk string, weekdays array<int>, hour int, readers int")
    day = F.explode(F.sequence(F.lit("2026-01-01").cast("date"), F.lit(AS_OF.date().isoformat()).cast("date")))
    calendar = spark.range(1).select(day.alias("day")).filter(~F.col("day").cast("string").isin(DAYS_OFF))
    regular = tiles.filter(~F.col("dashboard_id").isin("solar_fair", "statutes")).join(F.broadcast(desks), "desk")
    regular = regular.join(F.broadcast(calendar), F.array_contains("weekdays", F.dayofweek("day")))
    turn = (F.dayofmonth("day") >= 28) | (F.dayofmonth("day") <= 3)
    regular = regular.select("dashboard_id", "tile_id", "desk", "k", "hour", "day", F.explode(F.sequence(F.lit(1), F.col("readers"))).alias("reader"), F.explode(F.sequence(F.lit(0), turn.cast("int"))).alias("again"))
    single = [("solar_fair", LAST_FAIR), *[("statutes", m) for m in MEETINGS]]
    rare = tiles.join(spark.createDataFrame(single, "dashboard_id string, on string"), "dashboard_id").select("dashboard_id", "tile_id", "desk", "k", F.lit(9).alias("hour"), F.col("on").cast("date").alias("day"), F.lit(1).alias("reader"), F.lit(0).alias("again"))
    rows = regular.unionByName(rare)
    minutes = F.col("hour") * 60 + F.col("again") * 180 + F.col("reader") * 11 + F.col("k") * 2
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return rows.select("dashboard_id", "tile_id", F.concat_ws("-", "desk", "reader").alias("user"), at.alias("timestamp"))


def files() -> dict[str, str]:
    """Every text file of the estate by its path."""
    declared = [{"name": t, "columns": [{"name": c} for c in columns]} for t, columns in TABLES.items()]
    sources = {"version": 2, "sources": [{"name": "grid", "database": "plant", "schema": "grid", "tables": declared}]}
    kinds = {"staging": "view", "intermediate": "ephemeral", "marts": "table"}
    config = {"name": PROJECT, "version": "1.0", "config-version": 2, "profile": PROJECT, "model-paths": ["models"], "models": {PROJECT: {k: {"materialized": v} for k, v in kinds.items()}}}
    texts = {f"project/models/{path}.sql": f"{sql}\n" for path, sql in MODELS.items()}
    texts["project/models/staging/sources.yml"] = yaml.safe_dump(sources, sort_keys=False)
    texts["project/dbt_project.yml"] = yaml.safe_dump(config, sort_keys=False)
    texts["dashboards.json"] = json.dumps(dashboards(), indent=1) + "\n"
    texts["manifest.yaml"] = yaml.safe_dump(manifest(), sort_keys=False)
    return texts


def generate(spark: SparkSession, root: str) -> dict[str, str]:
    """Writes the estate below a local folder, verifies that the loaders read what the manifest names, and returns the digests of its parts."""
    from ..functions.hashing import table_fingerprint, utc_text
    from ..plans.verify import verify

    digests = {}
    for name, body in files().items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
        digests[name] = hashlib.sha256(body.encode()).hexdigest()
    base = f"file://{os.path.abspath(root)}"
    write_query_log(query_log(spark), f"{base}/query_log.parquet")
    log = spark.read.parquet(f"{base}/query_log.parquet").withColumn("timestamp", utc_text(F.col("timestamp")))
    digests["query_log.parquet"] = table_fingerprint(log, *log.columns).first()[0]  # of its rows: files may differ
    failed = [r.id for r in verify(spark, load(spark, root), f"{base}/manifest.yaml").filter("not passed").collect()]
    if failed:
        raise AssertionError(f"the estate doesn't hold what its manifest says: {failed}")
    return dict(sorted(digests.items()))


def load(spark: SparkSession, root: str):
    from ..plans.audit import load_estate

    base = f"file://{os.path.abspath(root)}"
    return load_estate(spark, f"{base}/project", f"{base}/dashboards.json", f"{base}/query_log.parquet")
