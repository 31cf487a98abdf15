"""Command line: index a repository and ask about it.

    python -m quarrylens index|status|report|dump|rules|conflicts|concepts REPO STORE
    python -m quarrylens evidence|why|impact|flow|explain|preflight|context REPO STORE TARGET [--json]
"""

from __future__ import annotations

import argparse
import json
import re

from pyspark.sql import DataFrame, SparkSession

from quarrylens.plans import answers
from quarrylens.plans.index import Index
from quarrylens.sources import records


def _rows(frame: DataFrame) -> list[dict]:
    return [json.loads(x) for x in frame.toJSON().toLocalIterator()]


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="quarrylens")
    parser.add_argument("command", choices=["index", "status", "report", "dump", "rules", "conflicts", "concepts", "evidence", "why", "impact", "flow", "explain", "preflight", "context"])
    parser.add_argument("repo")
    parser.add_argument("store")
    parser.add_argument("target", nargs="?", default="")
    parser.add_argument("--budget", type=int, default=4000)
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarrylens").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    index = Index(spark, args.store)
    if args.command == "index":
        out = index.update(args.repo)
    elif args.command == "status":
        out = index.status(args.repo)
    elif args.command == "report":
        out = {"report": _rows(answers.report(index.nodes(), index.edges()))}
    elif args.command == "dump":
        out = {"dump": _rows(index.dump())}
    elif args.command in ("rules", "conflicts", "concepts"):
        out = {args.command: _rows(getattr(index, args.command)())}
    elif args.command == "evidence":
        out = {"evidence": _rows(index.evidence(args.target))}
    elif args.command == "why":
        from pyspark.sql import functions as F

        told = index.nodes().where("kind = 'Symbol'").select(F.concat_ws(":", "path", F.col("line_start").cast("string")).alias("location"), F.get_json_object("payload", "$.summary").alias("documentation"))
        out = {k: _rows(v) for k, v in answers.why(index.nodes(), index.edges(), told, args.target).items()}
        if place := re.fullmatch(r"(.*):(\d+)", args.target):
            out["line_history"] = [{"sha": sha, "subject": subject} for sha, subject in records.line_history(args.repo, place[1], int(place[2]), int(place[2]))]
    elif args.command == "impact":
        out = {"impact": _rows(answers.impact(index.nodes(), index.edges(), args.target))}
    elif args.command == "flow":
        out = {"flow": _rows(answers.flow(index.nodes(), index.edges(), args.target))}
    elif args.command == "explain":
        out = {k: _rows(v) for k, v in answers.explain(index.nodes(), index.edges(), args.target).items()}
    elif args.command == "preflight":
        out = {"preflight": _rows(answers.preflight(index.nodes(), index.edges(), args.target))}
    else:
        found = answers.context(index.nodes(), index.edges(), index.files(), index.prior(), args.target, args.budget, args.exclude, index.bodies())
        out = found | {"files": _rows(found["files"])}
    print(json.dumps(out, indent=None if args.json else 2, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main()
