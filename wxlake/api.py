"""The verbs of the engine: each takes a session and paths, and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .operators import archive, reports, summaries
from .session import exists, settled, ship
from .sources import files
from .sources.stanza import stanza

__all__ = [
    "active_warnings_at",
    "archive_import",
    "archive_prune_plan",
    "archive_verify",
    "collect_input_paths",
    "input_failures",
    "inspect_bytes",
    "inspect_path",
    "inspect_text",
    "lead_time_metrics",
    "parse_bulletin",
    "parse_oi",
    "polygon_timeline",
    "replay_path",
    "scan_path",
    "semantic_fingerprint",
    "split_pid201",
    "write_pid201_split",
]


def _inspected(spark: SparkSession, path: str, hint: str | None = None, per_frame: bool = False) -> DataFrame:
    return files.inspected(files.messages_at(ship(spark), path, hint), per_frame)


def collect_input_paths(spark: SparkSession, path: str) -> list[str]:
    """Paths of the inputs below a folder, relative to it, ordered part by part. A list for a person; jobs take inputs()."""
    return [r.path for r in files.inputs(spark, path).select("path").orderBy(F.split("path", "/")).collect()]


def inspect_path(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """Summaries of the messages below a path."""
    return summaries.message_summaries(_inspected(spark, path, hint))


def inspect_text(spark: SparkSession, text: str) -> DataFrame:
    row = ship(spark).createDataFrame([("", 1, text)], "path string, message_index int, raw string")
    return summaries.message_summaries(reports.parsed(row))


def inspect_bytes(spark: SparkSession, content: bytes, hint: str = "auto") -> DataFrame:
    """Summaries of the messages in a file's bytes."""
    row = ship(spark).createDataFrame([("", bytearray(content), hint)], "path string, content binary, hint string")
    return summaries.message_summaries(files.inspected(files.messages(row)))


def parse_bulletin(spark: SparkSession, text: str) -> DataFrame:
    """One row with all columns of a bulletin, or its error."""
    return reports.parsed(ship(spark).createDataFrame([("", 1, text)], "path string, message_index int, raw string"))


def parse_oi(spark: SparkSession, xml: str) -> DataFrame:
    """One row with the fields of a stanza and its wrapped bulletin, or its error."""
    return ship(spark).createDataFrame([(xml,)], "xml string").select(stanza(F.col("xml")).alias("s")).select("s.*")


def write_pid201_split(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The messages of framed streams as a table below `out`, each with the file name that it is split to."""
    split_pid201(spark, path).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def scan_path(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Counts by kind and transport, families, totals, and the files that failed."""
    known = settled(_inspected(spark, path), "scan")
    return {"counts": reports.scan_counts(known), "families": reports.family_counts(known), "totals": reports.totals(known), "errors": summaries.error_rows(known)}


def replay_path(spark: SparkSession, path: str) -> DataFrame:
    return summaries.replay_records(_inspected(spark, path))


def active_warnings_at(spark: SparkSession, path: str, at: str) -> DataFrame:
    messages = files.messages_at(ship(spark), path).where("input_error is null")
    return reports.with_digests(settled(reports.active_at(messages, at), "active"), messages).orderBy("key")


def input_failures(spark: SparkSession, path: str) -> DataFrame:
    """Files and messages below a path that active_warnings_at, polygon_timeline and lead_time_metrics leave out, and why."""
    return summaries.error_rows(_inspected(spark, path, per_frame=True))


def polygon_timeline(spark: SparkSession, path: str, at: str | None = None) -> DataFrame:
    """Timeline records in their order; of a framed stream, bad frames are left out one by one."""
    return reports.ordered(reports.timeline(files.messages_at(ship(spark), path).where("input_error is null"), at))


def lead_time_metrics(spark: SparkSession, path: str, event_at: str, lat: float, lon: float) -> DataFrame:
    event = spark.createDataFrame([(1, event_at, lat, lon)], "event int, t string, lat double, lon double")
    event = event.select("event", F.to_timestamp(F.replace(F.rtrim(F.col("t"), F.lit("Z")), F.lit("T"), F.lit(" "))).alias("event_time"), "lat", "lon")
    records = reports.records(files.messages_at(ship(spark), path).where("input_error is null"), event_at, ("lat_lon",))
    return reports.lead_times(records, event)


def archive_import(spark: SparkSession, source: str, store: str) -> DataFrame:
    """Add the messages below a path to an archive; what happened to each of them.

    Below `store` are the records, the manifest and an index of the records' digests in folders by their first two digits.
    An import reads the index alone, and of it the folders that its own digests name.
    """
    place = f"{store}/index.parquet"
    known = archive.with_digest(_inspected(spark, source)).withColumn("shard", F.substring("digest", 1, 2))
    old = None
    if exists(spark, place):
        known = archive.numbered(known)
        old = spark.read.schema("folder string, digest string, text_digest string, number int, shard string").parquet(place)
        old = old.join(F.broadcast(known.select("shard").distinct()), "shard", "left_semi")  # 256 rows at most; prunes folders
    done = settled(archive.imported(known, old), "imported")
    new = done.where(F.col("action") == "archived")
    new.select("folder", "digest", "relative_path", "bulletin").write.mode("append").parquet(f"{store}/records.parquet")
    archive.manifest(done).write.mode("append").parquet(f"{store}/manifest.parquet")
    # Last, so that an import that fails before is done again: records are named by their texts and can be told.
    new.select(*archive.INDEX, "shard").repartition("shard").write.mode("append").partitionBy("shard").parquet(place)
    return done.select("path", "message_index", "action", "relative_path", "transport", "heading", "family")


def archive_verify(spark: SparkSession, store: str) -> DataFrame:
    """Status of each record of an archive, read and parsed again."""
    stored = ship(spark).read.parquet(f"{store}/records.parquet").select("relative_path", F.col("bulletin").alias("raw"))
    return archive.verified(reports.parsed(stored.withColumns({"path": F.col("relative_path"), "message_index": F.lit(1)})))


def archive_prune_plan(spark: SparkSession, store: str, before: str) -> DataFrame:
    """What pruning a partitioned archive before a date would remove."""
    return archive.prune_plan(spark.read.parquet(store), F.lit(before).cast("date"))


def split_pid201(spark: SparkSession, path: str) -> DataFrame:
    """The messages of framed streams with the file names that they are split to."""
    good = _inspected(spark, path, "framed", per_frame=True).where("error_kind is null")
    return good.select("path", "message_index", archive.split_name(F.col("message_index")).alias("name"), "byte_start", "byte_end", "bulletin")


def semantic_fingerprint(rows: DataFrame) -> DataFrame:
    """Add the fingerprint to parsed messages."""
    good = rows.where("error_kind is null")
    return good.withColumn("semantic_fingerprint", hashing.blake3(hashing.fingerprint_text(F.col("heading"), F.col("awips_id"), F.col("body"))))
