"""The command line: python -m wxlake COMMAND PATH ... [--format text|json|jsonl|tool-result] [--out TABLE]

A report goes to a Parquet table with --out; without it, json and jsonl print every row as it comes, while text and tool-result,
which need all rows at once, are an error beyond --most. What could not be read is told on the error output.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import api
from .operators import archive, summaries
from .session import settled


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="wxlake")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *extra: tuple[str, dict]) -> None:
        own = commands.add_parser(name)
        own.add_argument("path")
        for flag, options in extra:
            own.add_argument(flag, **options)
        own.add_argument("--format", choices=("text", "json", "jsonl", "tool-result"), default="text")
        own.add_argument("--out")
        own.add_argument("--most", type=int, default=10_000)

    at = ("--at", {"required": True})
    for name in ("inspect", "replay", "scan", "summary", "split", "archive-verify"):
        command(name)
    command("active-at", at)
    command("timeline", ("--at", {}))
    command("lead-time", ("--event-at", {"required": True}), ("--lat", {"type": float, "required": True}), ("--lon", {"type": float, "required": True}))
    command("archive-import", ("--archive", {"required": True}))
    command("archive-prune", ("--before", {"required": True}), ("--dry-run", {"action": "store_true"}))
    return parser.parse_args(given)


def _report(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    match a.command:
        case "inspect":
            return api.inspect_path(spark, a.path)
        case "replay":
            return api.replay_path(spark, a.path)
        case "scan":
            return api.scan_path(spark, a.path)["counts"]
        case "summary":
            return api.scan_path(spark, a.path)["families"]
        case "split":
            return api.split_pid201(spark, a.path)
        case "active-at":
            return api.active_warnings_at(spark, a.path, a.at)
        case "timeline":
            return api.polygon_timeline(spark, a.path, a.at)
        case "lead-time":
            return api.lead_time_metrics(spark, a.path, a.event_at, a.lat, a.lon)
        case "archive-import":
            return api.archive_import(spark, a.path, a.archive)
        case "archive-verify":
            return api.archive_verify(spark, a.path)
    plan = settled(api.archive_prune_plan(spark, a.path, a.before), "prune")
    if not a.dry_run:
        archive.prune(spark, a.path, a.before)
    return plan


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(given)
    spark = spark or SparkSession.builder.appName("wxlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = _report(spark, a)
    if a.out:
        rows.write.parquet(a.out)
        return 0
    if a.command in ("active-at", "timeline", "lead-time"):
        for line in summaries.as_json(api.input_failures(spark, a.path)).toLocalIterator():
            print(line.value, file=sys.stderr)
    if a.format == "text":
        rows = settled(rows, "report")
        if rows.count() > a.most:
            raise SystemExit(f"more than {a.most} rows: choose another format or --out")
        rows.show(a.most, truncate=80)
    elif a.format == "tool-result":
        key = {"inspect": "messages", "active-at": "warnings", "timeline": "timeline", "archive-import": "actions"}.get(a.command, "records")
        print(summaries.enveloped(rows, a.command, key, {"source_path": a.path}, {"command": a.command}, a.most))
    elif a.format == "jsonl":
        for line in summaries.as_json(rows).toLocalIterator():
            print(line.value)
    else:
        mark = "["
        for line in summaries.as_json(rows).toLocalIterator():
            print(mark + line.value)
            mark = ","
        print("[]" if mark == "[" else "]")
    return 0


if __name__ == "__main__":
    sys.exit(main())
