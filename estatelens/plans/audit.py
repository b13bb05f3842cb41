"""The audit end to end: metadata in, findings out; and the sinks of its results."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import after_first_dot
from ..operators import relational
from ..schemas import DEFECT_TYPES, FINDINGS, finding_violations, require_none
from ..session import written
from ..sources import dashboards as dashboard_source
from ..sources import project as project_source
from ..sources import querylog
from . import checks, dag, definitions, lineage


@dataclass
class Estate:
    """Everything that is known of an analytics estate, as tables."""

    models: DataFrame
    sources: DataFrame
    dashboards: DataFrame
    tiles: DataFrame
    log: DataFrame | None
    log_path: str
    as_of: dt.datetime
    nodes: DataFrame
    edges: DataFrame
    lineage: lineage.Lineage


def utc(value: str) -> dt.datetime:
    """An ISO time with Z, as a naive UTC time."""
    return dt.datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(dt.UTC).replace(tzinfo=None)


def load_estate(spark: SparkSession, project: str, dashboards: str, log: str | None) -> Estate:
    models, sources = project_source.load_project(spark, project)
    models, sources = written(models, "models"), written(sources, "sources")
    boards, tiles, as_of = dashboard_source.load_dashboards(spark, dashboards)
    tiles = written(tiles, "tiles")
    nodes, edges = dag.build_dag(models, sources, tiles)
    entries = querylog.load_query_log(spark, log) if log else None
    return Estate(models, sources, boards, tiles, entries, log or "", utc(as_of), nodes, edges, lineage.build_lineage(spark, models, sources, tiles))


def structural_findings(estate: Estate) -> DataFrame:
    out = checks.orphaned_models(estate.models, estate.edges)
    if estate.log is not None:
        out = out.unionByName(checks.stale_dashboards(estate.dashboards, estate.log, estate.log_path, estate.as_of))
    out = out.unionByName(checks.duplicate_dashboards(estate.dashboards, estate.tiles))
    return out.unionByName(checks.broken_references(estate.lineage)).unionByName(checks.unused_propagation(estate.lineage))


def run_audit(spark: SparkSession, estate: Estate, provider: definitions.Provider | None = None, cache_path: str | None = None, progress: Callable[[str], None] = lambda says: None, judge_tasks: int = 0) -> tuple[DataFrame, DataFrame, dict]:
    """(findings, judged candidates, totals of the judge); the fixed rules judge unless a provider does, on the driver or in judge_tasks tasks at a time, whose answers cache_path keeps."""
    progress("candidates")
    pairs = written(definitions.candidates(spark, estate.models, estate.tiles, estate.lineage.aggregates), "candidates")
    if provider is None:
        judged, totals = definitions.judge(pairs), definitions.usage_totals(pairs.withColumn("raw", F.lit("rules"))).first().asDict()
    else:
        cache = definitions.load_cache(spark, cache_path) if cache_path else None
        keep = (lambda answers: definitions.save_answers(answers, cache_path)) if cache_path else None
        judged, answers, totals = definitions.judge_with(pairs, provider, cache, progress, judge_tasks, keep)
        if cache_path:
            definitions.save_answers(answers, cache_path)
    progress(f"judged: {totals}")
    found = written(structural_findings(estate).unionByName(definitions.drift_findings(judged)), "findings")
    require_none(finding_violations(found).select("id"), "invalid findings")
    return found, judged, totals


def build_summary(estate: Estate) -> dict:
    """What `build` reports: counts, coverage, fingerprints and the findings that need no log and no judge."""
    found = checks.orphaned_models(estate.models, estate.edges).unionByName(checks.broken_references(estate.lineage)).unionByName(checks.unused_propagation(estate.lineage))
    by_node, by_edge = dag.by_layer(estate.nodes, estate.edges)
    covered = lineage.tile_coverage(estate.lineage).first()
    return {
        "nodes": estate.nodes.count(), "edges": estate.edges.count(),
        "nodes_by_layer": {r[0]: r[1] for r in sorted(by_node.collect())}, "edges_by_layer": {r[0]: r[1] for r in sorted(by_edge.collect())},
        "models_by_layer": {r[0]: r[1] for r in sorted(dag.models_by_layer(estate.models).collect())},
        "graph_fingerprint": dag.fingerprint(estate.nodes, estate.edges).first()[0], "lineage_fingerprint": lineage.fingerprint(estate.lineage).first()[0],
        "lineage_columns": estate.lineage.columns.count(), "lineage_edges": estate.lineage.edges.count(),
        "unresolved": [r.asDict() for r in estate.lineage.unresolved.select("target_id", "reason_code", "upstream_relation", "column_name").orderBy("target_id").collect()],
        "tile_columns": covered["total"], "traced_tile_columns": covered["clean"], "coverage_percent": covered["percent"],
        "findings": sorted(r[0] for r in found.select("id").collect()),
    }


def as_json(findings: DataFrame) -> str:
    """Findings as canonical JSON, sorted: the same bytes for the same findings."""
    rows = [r.asDict(recursive=True) for r in findings.orderBy("id").collect()]
    return json.dumps({"findings": rows}, sort_keys=True, indent=1, ensure_ascii=False) + "\n"


def write_findings(findings: DataFrame, path: str) -> None:
    """A local JSON file, replaced in one step; for many findings use write_table."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(as_json(findings))
    os.replace(f"{path}.tmp", path)


def load_findings(spark: SparkSession, path: str) -> DataFrame:
    schema = f"findings array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields(FINDINGS))}>>"
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode("findings").alias("f")).select("f.*")


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def findings_by_type(findings: DataFrame) -> DataFrame:
    """(defect_type, findings) of every type, those without findings too: a legend."""
    types = findings.sparkSession.createDataFrame([(t,) for t in DEFECT_TYPES], "defect_type string")
    return types.join(findings.groupBy("defect_type").agg(F.count(F.lit(1)).alias("n")), "defect_type", "left").select("defect_type", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def graph_export(estate: Estate, findings: DataFrame) -> dict:
    """Nodes with the findings that concern them (a dashboard's go to its tiles), edges, findings and the legend: what a viewer needs."""
    targets = estate.nodes.join(estate.tiles.select("id", F.concat(F.lit("dashboard."), "dashboard_id").alias("dashboard")), "id", "left")
    concern = relational.fan_out(findings.select(F.explode("asset_ids").alias("asset"), F.col("id").alias("finding")), targets, "asset", "dashboard", "id", "finding")
    nodes = estate.nodes.join(concern, "id", "left").select("id", "kind", "layer", dag.layer_rank(F.col("layer")).alias("rank"), after_first_dot(F.col("id")).alias("label"), F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))
    return {
        "nodes": [r.asDict() for r in nodes.orderBy("rank", "id").collect()],
        "edges": [r.asDict() for r in estate.edges.select("source_id", "target_id", "kind").orderBy("source_id", "target_id").collect()],
        "findings": {r.id: r.asDict() for r in findings.select("id", "defect_type", "summary", "confidence").orderBy("id").collect()},
        "legend": {r.defect_type: r.findings for r in findings_by_type(findings).orderBy("defect_type").collect()},
    }


def placed(export: dict, sweeps: int = 4) -> dict[str, tuple[int, int]]:
    """Column and row of each node: columns are layers; a layer's nodes are ordered, sweep by sweep, by the mean row of what they read."""
    columns: dict[str, list[str]] = {}
    for n in export["nodes"]:
        columns.setdefault(n["layer"], []).append(n["id"])
    at = {i: (c, r) for c, ids in enumerate(columns.values()) for r, i in enumerate(ids)}
    reads: dict[str, list[str]] = {}
    for e in export["edges"]:
        reads.setdefault(e["target_id"], []).append(e["source_id"])
    for _ in range(sweeps):
        for c, ids in enumerate(columns.values()):
            pull = {i: [at[up][1] for up in reads.get(i, []) if up in at] or [at[i][1]] for i in ids}
            at |= {i: (c, r) for r, i in enumerate(sorted(ids, key=lambda i: (sum(pull[i]) / len(pull[i]), i)))}
    return at


def script_safe(value) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(value, sort_keys=True).replace("</", "<\\/")


_VIEWER = """<!doctype html><meta charset="utf-8"><title>Lineage</title>
<style>body{font:13px sans-serif;margin:0;display:flex}#side{width:320px;padding:12px;border-right:1px solid #ccc;height:100vh;overflow:auto}
#main{overflow:auto;height:100vh;flex:1}text{cursor:pointer}.bad{fill:#b00020}.off{opacity:.15}.on{font-weight:bold}path{stroke:#bbb;fill:none}path.on{stroke:#06c}</style>
<div id="side"><input id="search" type="search" placeholder="Search" aria-label="Search"><h3>Findings</h3><ul id="legend"></ul><div id="detail"></div></div>
<div id="main"><svg id="graph"></svg></div><script type="application/json" id="data">%s</script><script>
const d=JSON.parse(document.getElementById("data").textContent),g=document.getElementById("graph"),ns="http://www.w3.org/2000/svg",names={},lines=[];
const xy=i=>[20+260*d.at[i][0],30+26*d.at[i][1]],make=(k,a)=>{const e=document.createElementNS(ns,k);for(const x in a)e.setAttribute(x,a[x]);return g.appendChild(e)};
for(const e of d.edges){const[a,b]=[xy(e.source_id),xy(e.target_id)];lines.push([e,make("path",{d:`M${a[0]+220} ${a[1]} C${a[0]+240} ${a[1]} ${b[0]-20} ${b[1]} ${b[0]} ${b[1]}`})])}
let w=0,h=0;for(const n of d.nodes){const[x,y]=xy(n.id),t=make("text",{x,y});t.textContent=n.label;if(n.findings.length)t.classList.add("bad");names[n.id]=t;t.onclick=()=>show(n);w=Math.max(w,x+260);h=Math.max(h,y+30)}
g.setAttribute("width",w);g.setAttribute("height",h);
for(const k in d.legend){const li=document.createElement("li");li.textContent=`${k}: ${d.legend[k]}`;li.onclick=()=>mark(n=>n.findings.some(f=>d.findings[f].defect_type===k));document.getElementById("legend").append(li)}
function mark(keep){for(const n of d.nodes)names[n.id].classList.toggle("off",!keep(n))}
document.getElementById("search").oninput=e=>mark(n=>n.id.toLowerCase().includes(e.target.value.toLowerCase()));
function show(n){for(const[e,p]of lines)p.classList.toggle("on",e.source_id===n.id||e.target_id===n.id);const box=document.getElementById("detail");box.replaceChildren();
const say=(k,s)=>{const e=document.createElement(k);e.textContent=s;box.append(e)};say("h3",n.id);say("p",n.kind+", "+n.layer);for(const f of n.findings)say("p",d.findings[f].summary);
for(const[e]of lines){if(e.target_id===n.id)say("div","reads "+e.source_id);if(e.source_id===n.id)say("div","read by "+e.target_id)}}
</script>
"""


def render_html(export: dict) -> str:
    """A page that shows the graph in columns by layer, with a legend of the findings, a search and the details of a node."""
    return _VIEWER % script_safe(export | {"at": placed(export)})
