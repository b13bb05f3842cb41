"""Command line: generate, build, verify, audit, eval, export."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .plans import audit, provider, scoring, verify
from .session import build_session
from .sources import fixture

COMMANDS = {
    "generate": "write the demonstration estate and verify it",
    "build": "graph and lineage, with the checks that need no log",
    "verify": "whether the loaders read what the manifest planted",
    "audit": "all checks",
    "eval": "score an audit against the manifest",
    "export": "the graph with its findings as JSON and HTML",
    "ask": "questions in words (not available)",
}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="estatelens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, says in COMMANDS.items():
        own = commands.add_parser(name, help=says)
        own.add_argument("--root", default=".", help="folder with project/, dashboards.json, query_log.parquet, manifest.yaml")
        own.add_argument("--out", default="audit.json", help="findings file")
        if name in ("audit", "export"):
            own.add_argument("--backend", choices=["rules", "chat"], default="rules", help="who judges candidate pairs")
            own.add_argument("--model", default="", help="the chat backend's model")
            own.add_argument("--url", default="", help="the chat backend's address")
            own.add_argument("--judge-tasks", type=int, default=0, help="tasks that call the chat backend at a time; 0: one call at a time on the driver")
            own.add_argument("--cache", default="", help="folder that keeps the chat backend's answers")
    return parser


def say(text: str) -> None:
    print(text, file=sys.stderr, flush=True)


def answer(value) -> None:
    print(json.dumps(value, indent=1))


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "ask":
        say("ask: not available")
        return 2
    spark, root = build_session(), os.path.abspath(args.root)
    manifest = f"file://{root}/manifest.yaml"
    if args.command == "generate":
        answer(fixture.generate(spark, root))
        return 0
    if args.command == "eval":
        card = scoring.score(audit.load_findings(spark, f"file://{os.path.abspath(args.out)}"), scoring.load_manifest(spark, manifest))
        answer(card.as_dict())
        return 0 if card.recall == 1 and not card.flagged_negative_ids else 1
    say("loading the estate")
    estate = fixture.load(spark, root)
    if args.command == "build":
        answer(audit.build_summary(estate))
        return 0
    if args.command == "verify":
        rows = [r.asDict() for r in verify.verify(spark, estate, manifest).orderBy("id").collect()]
        answer(rows)
        return 0 if all(r["passed"] for r in rows) else 1
    judge = provider.ChatProvider(args.model, args.url) if args.backend == "chat" else None
    cache = f"file://{os.path.abspath(args.cache)}" if args.cache else None
    findings, judged, totals = audit.run_audit(spark, estate, judge, cache, say, args.judge_tasks)
    if args.command == "audit":
        audit.write_findings(findings, args.out)
        answer({"findings": findings.count(), "candidates": judged.count(), "judge": totals, "out": args.out})
        return 0
    export = audit.graph_export(estate, findings)
    with open(f"{args.out}.graph.json", "w", encoding="utf-8") as f:
        json.dump(export, f, indent=1, sort_keys=True)
    with open(f"{args.out}.html", "w", encoding="utf-8") as f:
        f.write(audit.render_html(export))
    return 0


if __name__ == "__main__":
    sys.exit(main())
