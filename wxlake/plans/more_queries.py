"""Queries over summaries, archives, wrappers, shapes and streams, each over the whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import sql
from ..functions import codes, geometry, hashing, times, vtec
from ..operators import archive, reports, summaries
from ..operators import bulletins as b
from ..session import files_below, moved, settled, shared_dir, spread
from ..functions.times import utc
from ..sources import files, ranges
from ..streaming import frames, jobs, stanzas
from . import render
from .queries import AT, _good, _known, text


def message_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries.message_summaries(_known(spark, sf_dir))
    return rows.select("path", "frame_kind", "sequence_number", "heading", "ttaaii", "cccc", "office", "yygggg", "bbb", "awips_id", "family", "segment_count", F.size("segments").alias("segments"), F.length("semantic_fingerprint").alias("fingerprint_digits"), F.length("archive_id").alias("digest_digits"), F.col("byte_range").isNull().alias("bare"))


def segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries.segment_summaries(_known(spark, sf_dir))
    return rows.select("path", "segment_index", "ugc_raw", F.array_join("ugcs", ",").alias("ugcs"), F.array_join("pvtec", ",").alias("pvtec"), F.size("hvtec").alias("hvtec"), F.array_join(F.transform("actions", lambda a: a["normalized_action"]), ",").alias("actions"), F.size("lat_lon").alias("corners"), F.size("time_mot_loc.locations").alias("locations"))


def replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.replay_records(_known(spark, sf_dir))


def action_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.segments(_good(spark, sf_dir), ["path"]).select("path", "segment_index", F.explode("actions").alias("a")).select("path", "segment_index", "a.action", "a.normalized_action", "a.vtec_index")


def hydrologic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event code of a segment with its first hydrologic code, where the phenomenon takes one, read natively."""
    rows = b.segments(_good(spark, sf_dir), ["path"]).where((F.size("pvtec") > 0) & (F.size("hvtec") > 0))
    pair = vtec.hydrologic_pair(F.col("pvtec")[0]["raw"], F.col("hvtec")[0]["raw"])
    rows = rows.select("path", "segment_index", pair.alias("p")).where("p is not null")
    ends = F.concat_ws("-", times.vtec_time_text(F.col("p.primary.valid_start")), times.vtec_time_text(F.col("p.primary.valid_end")))
    return rows.select("path", "segment_index", "p.primary.phenomenon", "p.hydrologic.nwsli", text(F.col("p.hydrologic.begin")).alias("begin"), ends.alias("times"))


def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each message look like a heading, an identifier, and event or hydrologic codes."""
    rows = render.messages(spark, sf_dir).select("path", F.explode(F.split("raw", "\n")).alias("line")).withColumn("line", F.btrim("line", F.lit(" \t\r\f")))
    shapes = {"headings": F.col("line").rlike(vtec.HEADING), "identifiers": F.col("line").rlike(vtec.IDENTIFIER), "event_codes": vtec.is_p_vtec(F.col("line")), "hydrologic_codes": vtec.is_h_vtec(F.col("line"))}
    return rows.groupBy("path").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in shapes.items()))


def product_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of bulletins whose identifier, two-letter beginning or title follows from the event."""
    known = reports.parsed(render.titled(spark, sf_dir))
    return known.select("path", "nnn", "family", codes.snake(F.col("family")).alias("snake"))


def wrapped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in stanzas: what the wrapper says, and the errors of wrappers that do not fit."""
    inputs = render.wrapped(spark, sf_dir).withColumn("hint", files.hint_of(F.col("path")))
    rows = files.inspected(files.messages(inputs))
    return rows.select("path", "input_kind", "transport", "wrapper_id", text(F.col("wrapper_issue")).alias("wrapper_issue"), "wrapper.summary", "wrapper.process_id", F.col("wrapper.sequence").cast("string").alias("sequence"), "awips_id", "error_kind", "error_field")


def wrapped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue times of records whose wrapper has one."""
    inputs = render.wrapped(spark, sf_dir).withColumn("hint", files.hint_of(F.col("path")))
    good = files.messages(inputs).where(F.col("input_error").isNull())
    return reports.records(good, AT).select("event_id", "path", "wrapper_id", text(F.col("issued_at")).alias("issued_at"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulletins = render.messages(spark, sf_dir)
    bare = bulletins.select("path", F.encode("raw", "UTF-8").alias("content"))
    inputs = bare.unionByName(render.streams(bulletins).select("path", "content")).withColumn("hint", files.hint_of(F.col("path")))
    return files.inspected(files.messages(settled(inputs, "inputs")), columns=("error_kind", "error_field"), parts=())


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(_scanned(spark, sf_dir))


def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.error_rows(_scanned(spark, sf_dir))


def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_counts(_scanned(spark, sf_dir))


def counters_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family histogram as one JSON object, in the order of its keys."""
    return summaries.counter_map(reports.family_counts(_known(spark, sf_dir, ("error_kind",), ())), "family").select(F.to_json("counters").alias("value"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that a framed stream's messages are split to."""
    inputs = render.streams(render.messages(spark, sf_dir)).withColumn("hint", F.lit("framed"))
    rows = files.inspected(files.messages(inputs), per_frame=True).where(F.col("error_kind").isNull())
    return rows.select("path", "message_index", archive.split_name(F.col("message_index")).alias("name"))


def _digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed messages with their digests and without their texts, which imports do not read further; written once for all imports."""
    return archive.numbered(archive.digested(_known(spark, sf_dir, archive.IMPORTED, archive.COUNTED)).drop("raw"), "parsed")


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages with a copy of each, and what importing them does."""
    known = _digested(spark, sf_dir).withColumns({"input_kind": F.lit("bulletin"), "transport": F.lit("plain_text")})
    both = known.unionByName(known.withColumns({"path": F.concat(F.lit("zz/"), "path"), "_row": -1 - F.col("_row")}))
    return both, archive.imported(both.where("error_kind is null"))


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, done = _imported(spark, sf_dir)
    return summaries.import_counts(settled(done.select("action", "transport", "family"), "imported"), both)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done = _imported(spark, sf_dir)
    return archive.manifest(done).select("source_path", "input_kind", "transport", "sequence", "ttaaii", "cccc", "awips_id", "family", "segments", F.concat_ws("/", F.slice(F.split("relative_path", "/"), 1, 4)).alias("folder"))


def archived_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import where every message of an even event is in the archive already."""
    known = _digested(spark, sf_dir).where("error_kind is null")
    even = F.substring("path", 5, 9).cast("long") % 2 == 0
    before = archive.imported(known.where(even)).where(F.col("action") == "archived")
    done = archive.imported(known, settled(before.select(*archive.INDEX), "index"))
    return done.select("path", "action")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of archived records, of which every 17th event's was changed after its import."""
    return _verified(spark, sf_dir).select(F.col("from").alias("path"), "status", "family")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = archive.with_digest(_known(spark, sf_dir, (*archive.IMPORTED, "bulletin"), ())).drop("raw")
    done = archive.imported(known).where(F.col("action") == "archived")
    changed = F.substring("path", 5, 9).cast("long") % 17 == 0
    stored = done.select(F.col("path").alias("from"), "relative_path", F.concat("bulletin", F.when(changed, F.lit("\n\nX")).otherwise("")).alias("raw"))
    again = reports.parsed(stored.withColumns({"path": F.col("relative_path"), "message_index": F.lit(1)}), ("heading", "error_kind", "error_field", "raw_digest"), ()).drop("raw")
    return archive.verified(again, "from")


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.verify_counts(_verified(spark, sf_dir))


def first_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First message of each fingerprint, where every message comes again with other line ends and in a frame."""
    rows = render.messages(spark, sf_dir)
    plain = F.replace(F.replace("raw", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\r\n"))
    again = rows.withColumns({"path": F.concat(F.lit("zz/"), "path"), "raw": F.concat(F.lit("\x01\r\r\n"), plain, F.lit("\x03"))})
    known = archive.fingerprinted(reports.parsed(rows.unionByName(again), (*archive.FINGERPRINTED, "frame_kind"), ()))
    return archive.first_of_each(known.select("path", "message_index", "heading", "frame_kind", "semantic_fingerprint")).select("path", "heading", "frame_kind")


def timeline_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records of the timeline in its order."""
    rows = reports.ordered(reports.records(render.messages(spark, sf_dir), AT)).limit(100)
    return rows.select("record_key", text(F.col("issued_at")).alias("issued_at"))


def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and times that pairs of warnings of different events share."""
    m = reports.pair_metrics(reports.overlapping_pairs(reports.records(render.messages(spark, sf_dir), AT, ("lat_lon",)), reports.MEASURED))
    square = F.round(F.col("polygon_overlap_area_square_degrees") * 10000).cast("long")
    return m.select("left_record_key", "right_record_key", "time_overlap_seconds", square.alias("shared"))


def ring_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in thousandths of a square degree, whether a point lies inside, and what a ring shares with the square that is
    moved by half a side, for rings of five shapes."""
    place = F.col("at")
    at = lambda step, base: ((place + step) / 10 + base).cast("float")
    moved = F.array(*(F.struct(at(y + 2, 30).alias("lat"), at(x + 2, -90).alias("lon")) for y, x in render.RINGS["square"]))
    thousandths = lambda c: F.round(c * 1000).cast("long")
    # Each polygon's shape is found once and dealt over all cores first: a small table is one file, and its rings are much work.
    rows = spread(render.rings(spark, sf_dir)).withColumns({"s": geometry.shape(F.col("polygon")), "moved": geometry.shape(moved)}).withColumn("solid", geometry.solid(F.col("s")))
    holds = lambda y, x: geometry.holds_point(F.col("solid"), at(y, 30), at(x, -90))
    return rows.select(
        "event_id",
        "shape",
        thousandths(geometry.area_of(F.col("s"))).alias("area"),
        F.size("s.corners").alias("corners"),
        F.col("s.crosses").alias("crosses"),
        F.col("s.convex").alias("convex"),
        holds(1, 1).alias("holds_near"),
        holds(3, 3).alias("holds_far"),
        holds(0, 2).alias("holds_border"),
        thousandths(geometry.shared_area(F.col("s"), F.col("moved"))).alias("shared"),
    )


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all messages, captured when they were issued."""
    known = reports.parsed(render.messages(spark, sf_dir, "issue"), archive.STORED, archive.COUNTED).drop("raw")
    return archive.stored(archive.first_of_each(archive.fingerprinted(known).drop("body")), "feed", F.col("issue"))


def recent_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = archive.recent(_archive(spark, sf_dir), 50, family="severe-thunderstorm")
    return newest.select(text(F.col("captured_at")).alias("captured_at"), F.length("fingerprint").alias("digits"))


def office_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived products whose office and identifier fit, whatever their letter case."""
    return archive.chosen(_archive(spark, sf_dir), office="kaab", pil="svr").select("source_path", "awips_id", "family_name")


def day_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the days around a time, of families that have event codes."""
    return archive.days(_archive(spark, sf_dir), times.utc(AT), 3, event_families_only=True).groupBy("capture_date", "family").agg(F.count("*").alias("products"))


def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.prune_plan(_archive(spark, sf_dir), F.lit("2024-01-15").cast("date")).select("capture_date", "records", "removed")


def pruned_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a written archive once days before a date are removed."""
    path = _folder(spark, "archive")
    archive.write(_archive(spark, sf_dir), path)
    archive.prune(spark, path, "2024-01-15")
    return spark.read.parquet(path).groupBy(F.col("capture_date").cast("string").alias("capture_date")).agg(F.count("*").alias("records"))


def compacted_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that was written in three parts, all its days from the 15th on compacted twice, before the third part and behind it."""
    path = _folder(spark, "archive")
    rows = settled(_archive(spark, sf_dir), "archived").withColumn("part", F.pmod(F.xxhash64("source_path"), F.lit(3)))
    for part in range(2):
        archive.write(rows.where(F.col("part") == part).drop("part"), path)
    days = [r.capture_date for r in rows.select("capture_date").distinct().where("capture_date >= '2024-01-15'").collect()]
    archive.compact(spark, path, days)
    archive.write(rows.where("part = 2").drop("part"), path)
    archive.compact(spark, path, days)
    archive.vacuum(spark, path)
    return archive.current(spark, path).groupBy(F.col("capture_date").cast("string").alias("capture_date"), "family").agg(F.count("*").alias("records"), F.count_distinct("source_path").alias("paths"))


def _asked(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the messages with the parsers as functions; names that it needs are gone from the session afterwards."""
    view = f"wx_{uuid.uuid4().hex}"
    sql.register(spark)
    render.messages(spark, sf_dir).createOrReplaceTempView(view)
    try:
        return spark.sql(text.format(messages=view))
    finally:
        spark.catalog.dropTempView(view)
        sql.unregister(spark)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsers called from SQL."""
    return _asked(
        spark,
        sf_dir,
        "WITH p AS (SELECT path, parse_bulletin(raw) AS m FROM {messages}), s AS (SELECT path, explode(m.parts) AS s FROM p WHERE m.error_kind IS NULL), "
        "c AS (SELECT path, parse_ugc(s.ugc) AS u, parse_pvtec(s.pvtec[0].raw) AS v FROM s WHERE size(s.pvtec) > 0) "
        "SELECT path, array_join(u, ',') AS ugcs, v.office, v.phenomenon, v.action, v.etn, date_format(v.valid_end, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS valid_end FROM c",
    )


def lateral_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by a lateral join with the table function."""
    return _asked(
        spark,
        sf_dir,
        "SELECT path, segment_index, array_join(ugcs, ',') AS ugcs, try_element_at(codes, 1).phenomenon AS phenomenon, try_element_at(codes, 1).etn AS etn, CASE WHEN size(codes) > 0 THEN headline END AS headline, size(polygon) AS corners, "
        "cast(round(polygon[0].lat * 100) AS bigint) AS lat, cast(round(polygon[0].lon * 100) AS bigint) AS lon FROM {messages}, LATERAL parse_segments(raw)",
    )


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive digests of a line of text for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat_ws(" ", F.lit("event"), "event_id", F.lit("of"), "user_id", "event_type")
    return e.select("event_id", hashing.fnv1a(line).alias("digest"), hashing.fnv1a(F.when(F.col("event_id") % 3 == 0, F.lit(""))).alias("digest_of_nothing"))


def sniffed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files without an ending, told by their bytes, which follow from the event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    text = F.element_at(F.array(*map(F.lit, render.SNIFFED)), (F.col("event_id") % len(render.SNIFFED) + 1).cast("int"))
    files_ = e.select(F.concat(F.lit("m/"), F.col("event_id")).alias("path"), F.encode(text, "UTF-8").alias("content")).withColumn("hint", files.hint_of(F.col("path")))
    return files.with_kind(files_).select("path", "hint", "input_kind", "transport")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hail of three decimals, in hundredths of an inch as rounded in single precision, and winds, of which every fifth does not fit
    and gives way to the gust behind it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    hail = F.format_string("%d.%03d", F.floor(F.col("event_id") % 4000 / 1000), F.col("event_id") % 1000)
    wind = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("WIND..."), 65536 + F.col("event_id") % 1000, F.lit("MPH MAX WIND GUST..."), F.col("event_id") % 90, F.lit(" MPH"))).otherwise(F.concat(F.lit("WIND..."), F.col("event_id") % 65536, F.lit("MPH")))
    text = F.concat(F.lit("NOUS41 KAAA 201530\nPNSAAA\n\nILC031-211630-\n\nMAX HAIL SIZE..."), hail, F.lit(" IN\n"), wind, F.lit("\n$$\n"))
    known = reports.parsed(e.select(F.col("event_id").cast("string").alias("path"), F.lit(1).alias("message_index"), text.alias("raw")), ("error_kind",), ("tags",))
    return b.segments(known, ["path"]).select("path", F.round(F.col("tags.hail_inches").cast("double") * 100).cast("long").alias("hail"), "tags.wind_mph")


# --- streams


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wxlake/{name}-{uuid.uuid4().hex}"


def _run(spark: SparkSession, rows: DataFrame, column: str, parts: int, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a stream over rows that arrive in as many micro-batches as `column` has values (0 .. parts - 1), in their order and in
    many files each. Before each one the query starts anew from its checkpoint."""
    path, ahead = _folder(spark, "feed"), _folder(spark, "feed_rows")
    rows.withColumn("_arrival", F.col(column)).write.partitionBy("_arrival").parquet(ahead)  # the feed's files, written once
    for i in range(parts):
        for f in files_below(spark, f"{ahead}/_arrival={i}"):
            moved(spark, f, f"{path}/{i}-{f.rpartition('/')[2]}")
        jobs.captured(start(spark.readStream.schema(rows.schema).parquet(path)))


def _to_table(out: str, checkpoint: str) -> Callable[[DataFrame], DataStreamWriter]:
    return lambda rows: rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)


def _thirds(rows: DataFrame, stream: str) -> DataFrame:
    """Contents cut into three pieces anywhere."""
    whole = rows.withColumn("third", (F.octet_length("content") / 3).cast("int"))
    piece = lambda i: F.expr(f"substring(content, {i} * third + 1, {'third' if i < 2 else 'octet_length(content)'})")
    return whole.select(F.col(stream).alias("stream"), F.explode(F.array(*(F.struct(F.lit(i).alias("number"), piece(i).alias("bytes")) for i in range(3)))).alias("p")).select("stream", "p.*")


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed streams that arrive in three pieces, cut anywhere, each in a micro-batch of its own."""
    pieces = _thirds(render.streams(render.messages(spark, sf_dir)), "path")
    out, checkpoint = _folder(spark, "frames"), _folder(spark, "checkpoint")
    _run(spark, pieces, "number", 3, lambda feed: _to_table(out, checkpoint)(frames.reassembled(feed)))
    rows = spark.read.parquet(out)
    told = F.when(F.col("raw").isNull(), F.col("frame_offset"))  # a stream's own row of each micro-batch
    return rows.groupBy("stream").agg(F.count("raw").alias("frames"), F.max("discarded_junk").alias("junk_bytes"), F.max_by("pending_bytes", told).cast("int").alias("pending_bytes"), F.count("error").alias("errors"))


def stream_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML streams of stanzas, other elements and comments that arrive in three pieces, cut anywhere: elements, and messages with
    a bulletin."""
    pieces = _thirds(render.stanza_streams(spark, sf_dir), "stream").withColumns({"number": F.col("number").cast("long"), "received_at": utc(AT)})
    out, checkpoint = _folder(spark, "fragments"), _folder(spark, "checkpoint")
    _run(spark, pieces, "number", 3, lambda feed: _to_table(out, checkpoint)(stanzas.fragments(feed)))
    found = settled(spark.read.parquet(out), "fragments")
    said = stanzas.feed(found).groupBy("path").agg(F.count("*").alias("messages"), F.count_distinct("wrapper_id").alias("wrapper_ids"))
    counts = found.groupBy("stream").agg(F.count("fragment").alias("fragments"), F.max("number").alias("last"), F.count("error").alias("errors"))
    return counts.join(said.withColumnRenamed("path", "stream"), "stream", "left").select("stream", "fragments", "last", "errors", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("wrapper_ids", F.lit(0)).alias("wrapper_ids"))


def _redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in three micro-batches: even events twice over as repeated rows, odd ones, and all again under other paths."""
    rows = render.messages(spark, sf_dir, F.col("issue").alias("received_at"))
    batch = (F.col("event_id") % 2).cast("int")
    own = F.struct("path", batch.alias("batch"))
    again = F.struct(F.concat(F.lit("zz/"), "path").alias("path"), F.lit(2).alias("batch"))
    copies = F.explode(F.when(batch == 0, F.array(own, own, again)).otherwise(F.array(own, again)))
    return rows.select("event_id", "message_index", "raw", "received_at", copies.alias("c")).select("event_id", "message_index", "raw", "received_at", "c.*")


def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with repeated rows, the last batch of which repeats every message, archived once each."""
    path, checkpoint = _folder(spark, "archive"), _folder(spark, "checkpoint")
    _run(spark, _redelivered(spark, sf_dir), "batch", 3, lambda feed: jobs.started(feed, jobs.archiving(path, "feed"), checkpoint))
    return spark.read.parquet(path).groupBy(F.col("capture_date").cast("string").alias("capture_date"), "family").agg(F.count("*").alias("records"))


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of that feed, kept by batch, across the restarts between its batches."""
    path, checkpoint, kept = _folder(spark, "archive"), _folder(spark, "checkpoint"), _folder(spark, "status")
    _run(spark, _redelivered(spark, sf_dir), "batch", 3, lambda feed: jobs.started(feed, jobs.lasting(jobs.archiving(path, "feed"), kept, "feed"), checkpoint))
    return jobs.status(spark, kept).select("feed", "batches", "received", "parsed", "rejected", "archived", "duplicates")


def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a feed in two micro-batches."""
    rules = [{"name": "tornado", "family": "tornado"}, {"name": "marine", "awips_prefix": "MWW"}, {"name": "both", "family": "tornado", "awips_prefix": "TORAA"}]
    rows = render.messages(spark, sf_dir).withColumn("batch", (F.col("event_id") % 2).cast("int"))
    path, checkpoint = _folder(spark, "routes"), _folder(spark, "checkpoint")
    _run(spark, rows, "batch", 2, lambda feed: jobs.started(feed, jobs.routing(rules, path, "rest"), checkpoint))
    return spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("messages"))


def stream_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed whose fingerprints are remembered for a time: copies that come in the next micro-batch go, and what is left is archived
    by a sink that reads the batch's own days only."""
    rows = render.messages(spark, sf_dir, F.col("issue").alias("received_at")).withColumn("batch", F.lit(0))
    again = rows.withColumns({"path": F.concat(F.lit("zz/"), "path"), "received_at": F.col("received_at") + F.expr("INTERVAL 5 MINUTES"), "batch": F.lit(1)})
    path, checkpoint = _folder(spark, "seen"), _folder(spark, "checkpoint")
    _run(spark, rows.unionByName(again), "batch", 2, lambda feed: jobs.started(jobs.recognised(feed, "60 days"), jobs.archiving(path, "feed"), checkpoint))
    return spark.read.parquet(path).select(F.col("source_path").alias("path"), F.col("family_name").alias("family"))


def repeated_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as two equal rows and a copy: one row of the three is archived."""
    known = settled(_known(spark, sf_dir, ("cccc", "ttaaii", "awips_id", "bulletin", "error_kind"), ()).drop("raw"), "parsed")
    done = archive.imported(known.unionByName(known).unionByName(known.withColumn("path", F.concat(F.lit("zz/"), "path"))))
    return done.groupBy("path", "action").agg(F.count("*").alias("rows"))


def colliding_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of records where all texts of a folder have the same digest, imported in two parts: the later part's numbers go on."""
    known = _digested(spark, sf_dir).where("error_kind is null").withColumn("digest", F.lit("00"))
    odd = F.substring("path", 5, 9).cast("long") % 2 == 1
    before = settled(archive.imported(known.where(odd)), "imported")
    after = archive.imported(known.where(~odd), before.where("action = 'archived'").select(*archive.INDEX))
    return before.select("path", "action", "relative_path").unionByName(after.select("path", "action", "relative_path"))


def stored_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed streams of 50,000 messages, written as files and read again in byte ranges: frames, junk, pending bytes, whether the
    frames' offsets follow one another, and whether the messages are in their order."""
    path = _folder(spark, "streams")
    rows = render.messages(spark, sf_dir).withColumn("stream", F.floor(F.col("event_id") / 50_000))
    record = F.concat(F.when(F.col("event_id") % 5 == 0, "~").otherwise(""), F.lit("\x01\r\r\n"), F.regexp_replace("raw", "WARNING [0-9]+", F.concat(F.lit("WARNING "), F.lpad(F.col("event_id").cast("string"), 9, "0"))))
    rows = rows.select("stream", "event_id", record.alias("value")).repartition("stream").sortWithinPartitions("stream", "event_id")
    rows.select("stream", "value").write.option("lineSep", ranges.END).partitionBy("stream").text(path)
    found = settled(ranges.frames(spark, path).withColumn("stream", F.regexp_extract("path", "stream=([0-9]+)", 1).cast("long")), "frames")
    order = Window.partitionBy("stream").orderBy("message_index")
    number = F.regexp_extract(F.col("raw").cast("string"), "WARNING ([0-9]+)", 1).cast("long")
    junk = (number % 5 == 0).cast("int")
    told = found.select("stream", (F.coalesce(F.lag("byte_end").over(order), F.lit(0)) + junk == F.col("byte_start")).alias("follows"), (number > F.coalesce(F.lag(number).over(order), F.lit(-1))).alias("rises"), (F.octet_length("raw") == F.col("byte_end") - F.col("byte_start")).alias("long"))
    scanned = ranges.scan(spark, path).select(F.regexp_extract("path", "stream=([0-9]+)", 1).cast("long").alias("stream"), "frames", "junk_bytes", "pending_bytes")
    return scanned.join(told.groupBy("stream").agg(F.every(F.col("follows")).alias("follow"), F.every(F.col("rises")).alias("in_order"), F.every(F.col("long")).alias("whole")), "stream")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        message_summaries, segment_summaries, replay_records, action_tags, hydrologic_pairs, line_shapes, product_families, wrapped_messages, wrapped_timeline, scan_totals, scan_errors, error_histogram, counters_json,
        split_names, import_counts, manifest, archived_import, verified, verify_counts, first_fingerprints, timeline_first, overlapping_pairs, ring_facts, recent_products, office_products,
        day_products, prune_plan, pruned_archive, compacted_archive, sql_functions, lateral_segments, stream_frames, stream_fragments, stream_archive, stream_status, stream_routes, stream_recognised,
        repeated_import, colliding_digests, stored_streams, text_digests, sniffed_kinds, measurements,
    )
}
