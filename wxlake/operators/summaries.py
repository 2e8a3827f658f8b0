"""What reports say of messages, segments, files and imports: summaries, counters, error rows, and their JSON forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geotext, hashing


def _segment(p: Column, office: Column) -> Column:
    """A segment of products() as its summary has it, coordinates in degrees."""
    motion = F.when(
        p["motion"].isNotNull(),
        F.struct(p["motion"]["raw"].alias("raw"), p["motion"]["time"].alias("time"), p["motion"]["direction_degrees"].alias("direction_degrees"), p["motion"]["speed_knots"].alias("speed_knots"), geotext.degrees(p["motion"]["locations"], office).alias("locations")),
    )
    tags = ("tornado_tag", "flash_flood_observed", "flash_flood_emergency", "hail_inches", "wind_mph", "damage_threat")
    return F.struct(
        p["headline"].alias("headline"),
        p["lines"].alias("body_lines"),
        p["dollars"].alias("separated_by_dollars"),
        p["ampersands"].alias("contains_andand"),
        p["ugc"].alias("ugc_raw"),
        p["ugcs"].alias("ugcs"),
        F.transform(p["pvtec"], lambda v: v["raw"]).alias("pvtec"),
        F.transform(p["hvtec"], lambda v: v["raw"]).alias("hvtec"),
        *(p["tags"][c].alias(c) for c in tags),
        p["text_tags"].alias("text_tags"),
        p["actions"].alias("actions"),
        geotext.degrees(p["lat_lon"]["points"], office).alias("lat_lon"),
        motion.alias("time_mot_loc"),
    )


def message_summaries(known: DataFrame) -> DataFrame:
    """One row a message that was parsed: path, message_index and the 18 columns of its summary."""
    good = known.where(F.col("error_kind").isNull())
    has = set(good.columns)
    null = lambda kind: F.lit(None).cast(kind)
    span = F.when(F.col("byte_start").isNotNull(), F.struct(F.col("byte_start").alias("start"), F.col("byte_end").alias("end"))) if "byte_start" in has else null("struct<start:long,end:long>")
    wrapper = F.when(F.col("wrapper_id").isNotNull(), F.struct(F.col("wrapper_id").alias("id"), F.col("wrapper_issue").alias("issue"))) if "wrapper_id" in has else null("struct<id:string,issue:timestamp>")
    return good.select(
        "path",
        "message_index",
        span.alias("byte_range"),
        wrapper.alias("wrapper"),
        "frame_kind",
        "sequence_number",
        "heading",
        "ttaaii",
        "cccc",
        F.col("cccc").alias("office"),
        "yygggg",
        "bbb",
        "awips_id",
        "family",
        hashing.blake3(hashing.fingerprint_text(F.col("heading"), F.col("awips_id"), F.col("body"))).alias("semantic_fingerprint"),
        hashing.blake3("bulletin").alias("raw_bulletin_blake3"),
        hashing.fnv1a(F.col("bulletin")).alias("archive_id"),
        F.size("parts").alias("segment_count"),
        F.transform("parts", lambda p: _segment(p, F.col("cccc"))).alias("segments"),
        F.col("bulletin").alias("raw_bulletin"),
    )


def segment_summaries(known: DataFrame) -> DataFrame:
    """One row a segment: path, message_index, segment_index (from 1) and the columns of its summary."""
    good = known.where(F.col("error_kind").isNull()).select("path", "message_index", "cccc", F.posexplode("parts").alias("_at", "_p"))
    return good.select("path", "message_index", (F.col("_at") + 1).alias("segment_index"), _segment(F.col("_p"), F.col("cccc")).alias("s")).select("path", "message_index", "segment_index", "s.*")


def replay_records(known: DataFrame) -> DataFrame:
    """One row a message, with the six columns that a replay lists."""
    return known.where(F.col("error_kind").isNull()).select("path", "message_index", "sequence_number", "ttaaii", "cccc", "awips_id", "family", F.size("parts").alias("segment_count"))


def error_rows(known: DataFrame) -> DataFrame:
    """One row a file that failed: its first error, as text. A file's errors never end a report."""
    said = F.concat_ws(": ", "error_kind", "error_field")
    bad = known.where(F.col("error_kind").isNotNull())
    # The error that spoilt the file comes before those that it spoilt.
    own = F.struct(F.col("error_kind") == "Rejected", F.col("message_index"))
    return bad.groupBy("path").agg(F.min_by(said, own).alias("error"))


def import_counts(done: DataFrame, known: DataFrame) -> DataFrame:
    """Counters of an import as rows (name, value, n): inputs, and records by action, transport and family."""
    paths = known.groupBy("path").agg(F.max(F.col("error_kind").isNotNull()).alias("bad"))
    n = {"scanned_inputs": F.count("*"), "parsed_inputs": F.count(F.when(~F.col("bad"), 1)), "failures": F.count(F.when(F.col("bad"), 1))}
    actions = done.groupBy("action").agg(F.count("*").alias("n")).select(F.concat("action", F.lit("_records")).alias("name"), F.lit(None).cast("string").alias("value"), "n")
    return _listed(paths.agg(*(c.alias(k) for k, c in n.items()))).unionByName(actions).unionByName(_by(done, "transport", "transports")).unionByName(_by(done, "family", "families"))


def verify_counts(status: DataFrame) -> DataFrame:
    """Counters of a verification: good records, failures, and the good ones by family."""
    counts = status.groupBy((F.col("status") == "ok").alias("ok"), "family").agg(F.count("*").alias("n"))  # one pass, as a record's status is much work
    item = lambda name, value, n: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    none, ok, n = F.lit(None), F.col("ok"), F.col("n")
    items = F.array(item("verified_records", none, F.when(ok, n).otherwise(0)), item("failures", none, F.when(~ok, n).otherwise(0)), F.when(ok, item("families", F.col("family"), n)))
    zeros = status.sparkSession.range(1).select(F.explode(F.array(item("verified_records", none, F.lit(0)), item("failures", none, F.lit(0)))).alias("x"))  # of no records
    return counts.select(F.explode(F.array_compact(items)).alias("x")).unionByName(zeros).select("x.*").groupBy("name", "value").agg(F.sum("n").alias("n"))


def _listed(totals: DataFrame) -> DataFrame:
    items = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(None).cast("string").alias("value"), F.col(c).alias("n")) for c in totals.columns))
    return totals.select(F.explode(items).alias("x")).select("x.*")


def _by(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "value", "n")


def counter_map(counts: DataFrame, key: str, n: str = "messages") -> DataFrame:
    """One row with a map of counters in the order of their keys. Keys are codes of a closed set, so the map is small."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(n).alias("value"))))).alias("counters"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a line of JSON, nulls written out: what a text sink takes."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


# Names of the envelope's tools, and the evidence that a list in a report stands for.
TOOLS = {
    "inspect": "warning.parse_text",
    "replay": "warning.replay",
    "active-at": "warning.active_at_reference",
    "timeline": "warning.timeline",
    "lead-time": "warning.lead_time_event_metrics",
    "archive-import": "warning.archive_import",
    "archive-verify": "warning.archive_verify",
    "oi-archive": "warning.oi_archive",
}
EVIDENCE = {"messages": "parsed_messages", "scanned_files": "scanned_files", "warnings": "active_warnings", "timeline": "timeline_records", "actions": "import_actions", "records": "records"}
LIMITATIONS = {
    "active-at": "Headings carry a day and a time only; the month is the one nearest to the reference time.",
    "timeline": "Statuses follow from the given messages alone.",
    "lead-time": "Coordinates are planar; areas are in square degrees.",
}


def tool_result(operation: str, data: dict, inputs: dict, provenance: dict, ok: bool = True) -> dict:
    """The envelope of a report that has been reduced to a dict; reports themselves stay DataFrames."""
    evidence = []
    for key, kind in EVIDENCE.items():
        if isinstance(found := data.get(key), (list, int)):
            evidence.append({"evidence_type": kind, "count": len(found) if isinstance(found, list) else found})
    if "missed_event" in data:
        evidence.insert(0, {"evidence_type": "warning_lead_time_metrics", "lead_time_seconds": data.get("lead_time_seconds"), "missed_event": data["missed_event"]})
    return {
        "schema_version": "wx.tool_result.v1",
        "tool_name": TOOLS.get(operation, "warning.unknown"),
        "ok": ok,
        "inputs": inputs,
        "data": data,
        "artifacts": [{"artifact_id": operation, "kind": "json", "media_type": "application/json", "description": "Report of the requested command"}],
        "evidence": evidence or [{"evidence_type": "parser_output"}],
        "limitations": [LIMITATIONS[operation]] if operation in LIMITATIONS else [],
        "provenance": provenance,
    }


def enveloped(rows: DataFrame, operation: str, key: str, inputs: dict, provenance: dict, most: int = 10_000) -> str:
    """A report's rows (at most `most`, or an error) in the envelope, as JSON."""
    lines = as_json(rows).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"more than {most} rows: write the report as a table instead")
    return json.dumps(tool_result(operation, {key: [json.loads(r.value) for r in lines]}, inputs, provenance))
