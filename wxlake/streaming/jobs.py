"""Streaming jobs: archive with deduplication and retention, routes, counters, pruning, and a supervisor that restarts.

A feed is a streaming DataFrame of messages (path, message_index, raw, received_at); any source that Spark can replay serves,
such as a folder that a receiver drops files into. Sinks work on micro-batches and can be repeated: what a batch has
written before it failed is found in the archive when it runs again, and is not written twice.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import archive, reports
from ..session import exists, scratch, settled

#: How long a feed that is not archived remembers fingerprints.
MEMORY = "1 hour"


def recognised(feed: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Parsed messages of a feed, each fingerprint once within `memory` of its arrival, with what an archive row is made of: a batch's
    rows move to their state, those that are dropped there too, so no other field and no second text goes with them. The state
    expires, so what a batch costs follows from its own rows; with Spark's RocksDB provider it need not fit in memory."""
    known = archive.fingerprinted(counted(reports.parsed(feed, archive.STORED, archive.COUNTED)).drop("raw")).drop("body")
    return known.withWatermark("received_at", memory).dropDuplicatesWithinWatermark(["semantic_fingerprint"])


def archiving(path: str, source: str, keep_days: int | None = None, duplicates: bool = False, memory_days: int | None = None) -> Callable[[DataFrame, int], dict]:
    """A sink that adds the messages of a micro-batch to the archive, and tells how many it was given and wrote.

    It takes a plain feed, whose known fingerprints an anti-join with the archive leaves out (two columns, of the last `memory_days`
    only where set), or the rows of recognised(), whose state has done so: then only the days that the batch itself has are
    read, which guards against a batch that is repeated. With `duplicates` every message is kept, and a repeated batch leaves out
    what its number has written. keep_days prunes the archive itself when a new day begins.
    """
    pruned: list[str] = []

    def write(batch: DataFrame, number: int) -> dict:
        spark = batch.sparkSession
        with scratch(spark):
            told, written = Observation(), Observation()
            fresh = "semantic_fingerprint" not in batch.columns
            # Nothing is observed in rows that adaptive execution proves empty and takes out, so it must leave them.
            rules, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
            if rule not in (left_out := spark.conf.get(rules, None) or ""):
                spark.conf.set(rules, ",".join(filter(None, (left_out, rule))))
            rows = archive.fingerprinted(_observed(reports.parsed(batch, archive.STORED, archive.COUNTED), told).drop("raw")).drop("body") if fresh else batch
            seen = spark.read.parquet(path) if exists(spark, path) else None
            if duplicates:
                rows = settled(rows, "batch")
                if seen is not None:
                    own = seen.where(F.col("batch") == number).select(F.col("fingerprint").alias("semantic_fingerprint"), F.col("source_path").alias("path"), "message_index").distinct()
                    rows = rows.join(own, ["semantic_fingerprint", "path", "message_index"], "left_anti")
            else:
                rows = archive.first_of_each(rows) if fresh else rows
                if seen is not None:
                    if not fresh:
                        rows = settled(rows, "batch")  # read for its days and for the join; without an archive they are read once
                        days = rows.select(F.date_format("received_at", "yyyy-MM-dd").alias("capture_date")).distinct()
                        seen = seen.withColumn("capture_date", F.col("capture_date").cast("string")).join(days, "capture_date", "left_semi")
                    elif memory_days is not None:
                        seen = seen.where(F.col("capture_date").cast("date") >= F.date_sub(F.current_date(), memory_days))
                    rows = rows.join(seen.select(F.col("fingerprint").alias("semantic_fingerprint")), "semantic_fingerprint", "left_anti")
            archive.write(archive.stored(rows, source, F.col("received_at"), number).observe(written, F.count("*").alias("archived"), F.date_format(F.max("captured_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_message_at")), path)
        today = datetime.now(UTC).date()
        if keep_days is not None and pruned[-1:] != [str(today)]:
            archive.prune(spark, path, str(today - timedelta(days=keep_days)))
            pruned.append(str(today))
        return (_metrics(told) if fresh else {}) | {"archived": 0} | _metrics(written)

    return write


def _metrics(seen: Observation) -> dict:
    """What was observed. Where adaptive execution proves rows empty it drops the observation with them."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def routing(rules: list[dict], path: str, default: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that writes each message below route=NAME for every rule that fits. A batch overwrites its own part when
    it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        good = reports.parsed(batch, ("heading", "awips_id", "cccc", "bulletin", "error_kind"), ()).where(F.col("error_kind").isNull())
        out = archive.routed(good, rules, default).select("route", "path", "message_index", "heading", "awips_id", "cccc", "family", "bulletin")
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(path)

    return write


#: Counters that lasting() keeps besides the number of batches.
LASTING = ("received", "parsed", "rejected", "bytes", "archived")


def lasting(sink: Callable[[DataFrame, int], dict], path: str, name: str) -> Callable[[DataFrame, int], dict]:
    """The sink, whose counters are kept below a path by feed and batch: they outlast restarts, and a batch that is repeated
    overwrites its own, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> dict:
        told = sink(batch, number)
        row = (number, *(told.get(c) for c in LASTING), told.get("last_message_at"))
        kind = "batch long, " + ", ".join(f"{c} long" for c in LASTING) + ", last_message_at string"
        batch.sparkSession.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/feed={name}/number={number}")
        return told

    return write


def status(spark: SparkSession, path: str) -> DataFrame:
    """What lasting() has counted, one row a feed."""
    rows = spark.read.parquet(path)
    duplicates = F.sum("parsed") - F.coalesce(F.sum("archived"), F.lit(0))
    return rows.groupBy("feed").agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LASTING), F.coalesce(duplicates, F.lit(0)).alias("duplicates"), F.max("last_message_at").alias("last_message_at"))


def started(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None) -> DataStreamWriter:
    """A writer of micro-batches into a sink; the caller chooses its trigger."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.queryName(name) if name else writer


def captured(writer: DataStreamWriter, seconds: float | None = None) -> bool:
    """Bounded capture: what is there now, or what comes within some seconds. Tells whether it ended by itself."""
    if seconds is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return True
    query = writer.start()
    try:
        return bool(query.awaitTermination(int(seconds)))
    finally:
        query.stop()


def counted(known: DataFrame, name: str = "ingest") -> DataFrame:
    """Parsed messages, observed: what Counters sums up."""
    return _observed(known, name)


def _observed(known: DataFrame, by: str | Observation) -> DataFrame:
    good = F.col("error_kind").isNull()
    return known.observe(by, F.count("*").alias("received"), F.count(F.when(good, 1)).alias("parsed"), F.count(F.when(~good, 1)).alias("rejected"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"))


class Counters(StreamingQueryListener):
    """Counters of all queries since the listener was added: batches, starts, failures, input rows and what counted() observed."""

    def __init__(self, name: str = "ingest") -> None:
        self.name = name
        self.n = dict.fromkeys(("starts", "stops", "failures", "batches", "input_rows", "received", "parsed", "rejected", "bytes"), 0)

    def onQueryStarted(self, event) -> None:
        self.n["starts"] += 1

    def onQueryProgress(self, event) -> None:
        self.n["batches"] += 1
        self.n["input_rows"] += event.progress.numInputRows
        row = event.progress.observedMetrics.get(self.name)
        for key in ("received", "parsed", "rejected", "bytes"):
            self.n[key] += row[key] if row is not None else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.n["stops"] += 1
        self.n["failures"] += event.exception is not None


def backoff(attempt: int, first: float = 1.0, most: float = 60.0, factor: float = 2.0, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait before an attempt (from 0): at least half of the grown wait, the other half by chance."""
    wait = min(first * factor**attempt, most)
    return wait / 2 + wait / 2 * draw()


def supervised(start: Callable[[int], StreamingQuery], tries: int | None = None, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> int:
    """Run a query, and start it again whenever it fails, waiting longer each time it fails without a batch between.

    start gets the number of the try, so that it can ask a source for more history on a reconnect; what overlaps is
    dropped by deduplication. Returns the number of tries once a query ends by itself; `tries` bounds them.
    """
    attempt = failures = 0
    while True:
        query = start(attempt)
        attempt += 1
        try:
            query.awaitTermination()
            return attempt
        except Exception:  # noqa: BLE001 the query's own failure, whatever it is
            if tries is not None and attempt >= tries:
                raise
            failures = 0 if query.lastProgress else failures
            sleep(backoff(failures, draw=draw))
            failures += 1
