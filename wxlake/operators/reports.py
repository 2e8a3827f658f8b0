"""Reports over messages: scan counts, warnings in effect, lifecycles, lead times, and pairs of warnings.

Messages are rows with path, message_index and raw (the bulletin's text), and where they came in a wrapper,
wrapper_id and wrapper_issue. All reports parse with the same functions and differ in what they make of event codes.

Orders that decide a result (the last record of an event, the argmax of a key) put a null issue time first and
compare paths part by part. Groups are reduced by partial aggregates and joined back, so an event with a large
share of all messages does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, geotext, hashing, times, vtec
from ..session import settled
from . import bulletins as b

TERMINAL = ("CAN", "EXP")
_KEYS = ["path", "message_index", "wrapper_id", "wrapper_issue", "heading", "yygggg", "cccc", "awips_id", "family"]


#: Fields of segments that reports of codes read, and their names there.
_OF_SEGMENT = {"ugc": "ugc_raw", "ugcs": "ugcs", "headline": "headline", "lat_lon": "lat_lon", "motion": "motion", "tags": "tags", "text_tags": "text_tags", "actions": "actions"}


def parsed(messages: DataFrame, columns: tuple[str, ...] | None = None, parts: tuple[str, ...] | None = None) -> DataFrame:
    """Messages with all bulletin and product columns, rejects included; or only those named, as in bulletins.products()."""
    for name, kind in (("wrapper_id", "string"), ("wrapper_issue", "timestamp")):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    return b.products(messages, columns=columns, parts=parts)


def _coded(messages: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Parsed messages with what codes() needs: no texts, and of segments the codes and some fields."""
    return parsed(messages, ("heading", "yygggg", "cccc", "awips_id", "error_kind"), ("pvtec", *parts))


def codes(known: DataFrame) -> DataFrame:
    """One row a P-VTEC code of parsed messages, with those columns of its segment that were parsed."""
    # Texts without anything like a code yield no rows; they are left out before segments are made.
    some = known.where(F.col("error_kind").isNull() & F.col("raw").contains("/")) if "raw" in known.columns else known.where(F.col("error_kind").isNull())
    segments = b.segments(some, _KEYS)
    return b.codes_of(segments, [*_KEYS, "segment_index", *(n for n in _OF_SEGMENT.values() if n in segments.columns)])


def order(issued: str = "issued_at") -> Column:
    """What records are ordered by."""
    return F.struct(F.col(issued), F.split("path", "/"), F.col("message_index"), F.col("segment_index"), F.col("vtec_index"))


def event_family() -> Column:
    return b.event_family(F.col("vtec"), F.col("family"))


# --- what is in effect


def active_key() -> Column:
    v = F.col("vtec")
    listed = F.when(F.size("ugcs") > 0, F.array_join("ugcs", ",")).otherwise("UNKNOWN")
    code = F.concat_ws(".", v["event_class"], v["phenomenon"], v["significance"], F.lpad(v["etn"].cast("string"), 4, "0"))
    return F.concat(F.lit("office="), v["office"], F.lit("|vtec="), code, F.lit("|ugc="), listed, F.lit("|family="), F.col("event_family"))


def warning_codes(known: DataFrame, at: str) -> DataFrame:
    """Warning codes of messages that are not in the future of a time, with issued_at, event_family and key."""
    rows = codes(known).where(F.col("vtec.significance") == "W")
    rows = rows.withColumns({"issued_at": b.issued(F.col("yygggg"), times.utc(at)), "event_family": event_family()})
    return rows.where(~F.coalesce(F.col("issued_at") > times.utc(at), F.lit(False))).withColumn("key", active_key())


def active_at(messages: DataFrame, at: str) -> DataFrame:
    """The warnings in effect at a time, one row a key, ordered by it.

    A cancellation or expiry ends its key; an update whose window does not hold the time is passed over, so an
    earlier record that does hold it stays. The key names the areas, so ending some of them leaves the others.
    """
    return _active(_coded(messages, _ACTIVE_PARTS), at)


_ACTIVE_PARTS = ("ugc", "ugcs", "headline", "tags")


def _active(known: DataFrame, at: str) -> DataFrame:
    rows = warning_codes(known, at)
    v = F.col("vtec")
    ends = v["action"].isin(*TERMINAL)
    rows = rows.where(ends | times.contains(v["valid_start"], v["valid_end"], times.utc(at)))
    record = F.struct(
        "path",
        "message_index",
        "segment_index",
        "vtec_index",
        "heading",
        times.rfc3339(F.col("issued_at")).alias("issued_at"),
        v["office"].alias("office"),
        F.col("cccc").alias("message_office"),
        "awips_id",
        F.col("family").alias("product_family"),
        "event_family",
        v["event_class"].alias("event_class"),
        v["action"].alias("action"),
        v["phenomenon"].alias("phenomenon"),
        v["significance"].alias("significance"),
        v["etn"].alias("etn"),
        times.rfc3339(v["valid_start"]).alias("start_time"),
        times.rfc3339(v["valid_end"]).alias("end_time"),
        v["raw"].alias("vtec"),
        "ugc_raw",
        "ugcs",
        "headline",
        F.col("tags.tornado_tag").alias("tornado_tag"),
        F.col("tags.damage_threat").alias("damage_threat"),
    )
    best = rows.groupBy("key").agg(F.max_by(record, order()).alias("r")).where(~F.col("r.action").isin(*TERMINAL))
    return best.select("key", "r.*").orderBy("key")


def with_digests(records: DataFrame, messages: DataFrame) -> DataFrame:
    """Add the digests of the records' texts. Records carry no text; those that are left over fetch it from the messages and parse
    it again, so no other exchange of a report moves texts."""
    place = ["path", "message_index"]
    texts = messages.join(records.select(*place).distinct(), place, "left_semi").dropDuplicates(place)
    read = b.products(texts.select(*place, "raw")).select(*place, hashing.blake3("bulletin").alias("raw_bulletin_blake3"), hashing.fnv1a(F.col("bulletin")).alias("archive_id"))
    return records.join(read, place, "left")


def active_counts(messages: DataFrame, at: str) -> DataFrame:
    """Counters of active_at: name, family (of `families` only) and n."""
    known = settled(_coded(messages, _ACTIVE_PARTS).drop("raw"), "parsed")
    good = F.col("error_kind").isNull()
    future = F.coalesce(b.issued(F.col("yygggg"), times.utc(at)) > times.utc(at), F.lit(False))
    totals = known.agg(F.count("*").alias("scanned"), F.count(F.when(good, 1)).alias("messages"), F.count(F.when(good & future, 1)).alias("future_messages"), F.count(F.when(~good, 1)).alias("failures"))
    listed = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in totals.columns))).alias("x")).select("x.name", F.lit(None).cast("string").alias("family"), "x.n")
    seen = warning_codes(known, at).agg(F.count("*").alias("n")).select(F.lit("warning_vtec_segments").alias("name"), F.lit(None).cast("string").alias("family"), "n")
    families = _active(known, at).groupBy(F.col("event_family").alias("family")).agg(F.count("*").alias("n")).select(F.lit("families").alias("name"), "family", "n")
    return listed.unionByName(seen).unionByName(families)


# --- lifecycles


def timeline(messages: DataFrame, at: str | None = None) -> DataFrame:
    """Every warning record with its lifecycle status at a time (null without one)."""
    return with_status(records(messages, at), at)


def records(messages: DataFrame, at: str | None = None, parts: tuple[str, ...] = tuple(_OF_SEGMENT)) -> DataFrame:
    """Warning records. parts: fields of segments that are needed; columns of the others are left out. The issue time is the wrapper's, else the heading's day and time near the query time,
    else near the code's start, else near its end."""
    rows = codes(_coded(messages, parts)).where(F.col("vtec.significance") == "W")
    v = F.col("vtec")
    near = [v["valid_start"], v["valid_end"]]
    anchors = [times.utc(at), *near] if at else near
    issued = F.coalesce("wrapper_issue", *(b.issued(F.col("yygggg"), a) for a in anchors))
    rows = rows.withColumns({"issued_at": issued, "event_id": vtec.event_id(v), "event_family": event_family()})
    place = F.concat(F.lit("|source="), F.col("path"), F.lit("|message="), F.col("message_index"), F.lit("|segment="), F.col("segment_index"), F.lit("|vtec="), F.col("vtec_index"))
    return rows.select(
        F.concat("event_id", place).alias("record_key"),
        "event_id",
        "path",
        "message_index",
        "segment_index",
        "vtec_index",
        "heading",
        "issued_at",
        "wrapper_id",
        "wrapper_issue",
        v["office"].alias("office"),
        F.col("cccc").alias("message_office"),
        "awips_id",
        F.col("family").alias("product_family"),
        "event_family",
        v["event_class"].alias("event_class"),
        v["action"].alias("action"),
        v["phenomenon"].alias("phenomenon"),
        v["significance"].alias("significance"),
        v["etn"].alias("etn"),
        v["valid_start"].alias("valid_start"),
        v["valid_end"].alias("valid_end"),
        v["valid_end"].alias("expires_at"),
        F.when(v["action"] == "CAN", F.col("issued_at")).alias("canceled_at"),
        F.when(~v["action"].isin("NEW", *TERMINAL), F.col("issued_at")).alias("updated_at"),
        v["raw"].alias("vtec"),
        *(c for name, columns in _of_segment().items() if name in parts for c in columns),
    )


def _of_segment() -> dict[str, list]:
    """Columns of a record by the field of its segment that they are made from."""
    moved = F.when(F.col("motion").isNotNull(), F.struct("motion.raw", "motion.time", "motion.direction_degrees", "motion.speed_knots", geotext.degrees(F.col("motion.locations"), F.col("cccc")).alias("locations")))
    return {
        "ugc": ["ugc_raw", F.substring(F.replace("ugc_raw", F.lit("\n"), F.lit("")), -7, 6).alias("ugc_purge_time")],
        "ugcs": ["ugcs"],
        "headline": ["headline"],
        "tags": ["tags"],
        "text_tags": ["text_tags"],
        "actions": ["actions"],
        "lat_lon": [geotext.degrees(F.col("lat_lon.points"), F.col("cccc")).alias("polygon"), F.col("lat_lon.raw").alias("polygon_raw")],
        "motion": [moved.alias("time_mot_loc")],
    }


def with_status(rows: DataFrame, at: str | None) -> DataFrame:
    """Add lifecycle_status: of an event's records that are not in the future the last one tells, the others are superseded."""
    if at is None:
        return rows.withColumn("lifecycle_status", F.lit(None).cast("string"))
    now, rows = times.utc(at), settled(rows, "records")
    future = F.coalesce(F.col("issued_at") > now, F.lit(False))
    last = rows.where(~future).groupBy("event_id").agg(F.max(order()).alias("_last"))
    own = (
        F.when(F.col("action") == "CAN", "canceled")
        .when(F.col("action") == "EXP", "expired")
        .when(F.col("valid_start") > now, "pending")
        .when(F.col("valid_end") <= now, "expired")
        .otherwise("active")
    )
    status = F.when(future, "future").when(~order().eqNullSafe(F.col("_last")), "superseded").otherwise(own)
    return rows.join(last, "event_id", "left").withColumn("lifecycle_status", status).drop("_last")


def ordered(rows: DataFrame) -> DataFrame:
    """Timeline records in their order: unknown issue times first, paths part by part."""
    return rows.orderBy(F.col("issued_at").asc_nulls_first(), F.split("path", "/"), "message_index", "segment_index", "vtec_index")


def interval(prefix: str = "") -> tuple[Column, Column]:
    """Start and end of a record's half-open interval, both null if it has none."""
    c = lambda name: F.col(prefix + name)
    start = F.coalesce(c("valid_start"), c("issued_at"), c("wrapper_issue"))
    end = F.coalesce(F.least(F.coalesce(c("valid_end"), c("expires_at")), c("canceled_at")))
    real = end > start
    return F.when(real, start), F.when(real, end)


# --- lead times

# Quality flags in their order.
FLAGS = ("no-warning-records", "missing-warning-interval", "missing-warning-polygon", "invalid-warning-polygon", "no-point-warning-intervals", "event-outside-point-warning-intervals", "warning-issued-after-event", "missed-event", "false-alarm-intervals-present")


#: Grids of cells with sides of 1, 2, 4 ... 256 degrees.
LEVELS = range(9)


def _cell(level: int | Column, y: Column, x: Column) -> Column:
    side = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.struct((F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"), F.floor(y / side).cast("int").alias("y"), F.floor(x / side).cast("int").alias("x"))


def _cells(box: Column) -> Column:
    """The cells, four at most, that a box touches on the finest grid whose cells are no smaller than the box."""
    size = F.greatest(box["north"] - box["south"], box["east"] - box["west"], F.lit(1.0))
    level = F.ceil(F.log2(size)).cast("int")
    return F.array_distinct(F.array(*(_cell(level, box[y], box[x]) for y in ("south", "north") for x in ("west", "east"))))


def lead_times(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Lead-time metrics of point events (event, event_time, lat, lon) against timeline records.

    Rings and their validity are found once a record. Boxes lie on the grid that fits their size, so a wide polygon takes four
    cells at most; points meet them by an equi-join on the cell of each grid, then the box, then the exact test decide.
    What covers a place, and its merged intervals, are found once for each place, however many events are there: events at one place
    would each repeat all its warnings. Of those, an event meets the ones in effect at its time by slices of time: intervals lie in
    two slices at most of the slicing that fits them.
    An event that no warning covers keeps its row. Flags that tell of the records themselves hold for every event alike.
    """
    start, end = interval()
    warns = rows.withColumns({"start": start, "end": end, "ring": geometry.with_area(geometry.ring(F.col("polygon")))})
    eligible, timed, shaped = ~F.col("action").isin(*TERMINAL), F.col("start").isNotNull(), F.col("polygon").isNotNull()
    warns = settled(warns.select("record_key", "event_id", "start", "end", F.coalesce("issued_at", "wrapper_issue", "start").alias("lead_start"), eligible.alias("eligible"), timed.alias("timed"), shaped.alias("shaped"), "ring"), "warnings")
    any_of = lambda c: F.coalesce(F.max(F.col("eligible") & c), F.lit(False))
    told = warns.agg(F.struct(F.count("*").alias("n"), any_of(~F.col("timed")).alias("interval"), any_of(F.col("timed") & ~F.col("shaped")).alias("polygon"), any_of(F.col("timed") & F.col("shaped") & F.col("ring").isNull()).alias("invalid")).alias("told"))
    placed = warns.where(F.col("eligible") & F.col("timed") & F.col("ring").isNotNull()).withColumn("box", geometry.box(F.col("ring")))
    placed = placed.select("record_key", F.col("event_id").alias("warning_event_id"), "start", "end", "lead_start", "ring", "box", F.explode(_cells(F.col("box"))).alias("cell"))
    place = ["lat", "lon"]
    points = events.select("event", "event_time", F.col("lat").cast("float").cast("double").alias("lat"), F.col("lon").cast("float").cast("double").alias("lon"))
    spots = points.select(*place).distinct().withColumn("cell", F.explode(F.array(*(_cell(level, F.col("lat"), F.col("lon")) for level in LEVELS))))
    near = F.col("lat").between(F.col("box.south"), F.col("box.north")) & F.col("lon").between(F.col("box.west"), F.col("box.east"))
    hits = spots.join(placed, "cell").where(near).where(geometry.holds_point(F.col("ring"), F.col("lat"), F.col("lon")))
    hits = settled(hits.select(*place, "record_key", "warning_event_id", "start", "end", "lead_start", _slicing(F.col("start"), F.col("end")).alias("slicing")), "hits")
    by_place = hits.groupBy(*place).agg(F.count("*").alias("point_warning_records"))

    # An event time lies in one slice of each slicing that is some interval's, so it meets an interval once.
    times_at = points.where("event_time is not null").select(*place, "event_time").distinct()
    asked = times_at.join(F.broadcast(hits.select("slicing").distinct())).withColumn("slice", _slice(F.col("event_time"), F.col("slicing")))
    sliced = hits.withColumn("slice", F.explode(F.sequence(_slice(F.col("start"), F.col("slicing")), _slice(F.col("end"), F.col("slicing")))))
    holds = (F.col("start") <= F.col("event_time")) & (F.col("event_time") < F.col("end"))
    before = F.col("lead_start") <= F.col("event_time")
    first = F.min_by(F.struct("record_key", "warning_event_id", "lead_start", "start", "end"), F.when(before, F.struct("lead_start", "record_key")))
    by_event = asked.join(sliced, [*place, "slicing", "slice"]).where(holds).groupBy(*place, "event_time").agg(
        F.count(F.when(before, 1)).alias("event_warning_records"),
        F.max(~before).alias("late"),
        F.when(F.count(F.when(before, 1)) > 0, first).alias("first"),
    )
    merged = settled(merged_intervals(hits, place), "islands")
    length = times.seconds(F.col("start"), F.col("end"))
    spans = merged.groupBy(*place).agg(F.count("*").alias("point_warning_interval_count"), F.sum(length).alias("point_warning_duration_seconds"))
    # Merged intervals are disjoint: at most one holds the event's time, all others are false alarms.
    held = times_at.join(merged, place).where(holds).select(*place, "event_time", length.alias("held_seconds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = points.join(by_place, place, "left").join(spans, place, "left").join(by_event, [*place, "event_time"], "left").join(held, [*place, "event_time"], "left")
    apart = F.when(F.col("event_time").isNull(), 0)
    others = {"false_alarm_interval_count": F.col("point_warning_interval_count") - F.when(F.col("held_seconds").isNotNull(), 1).otherwise(0), "false_alarm_duration_seconds": F.col("point_warning_duration_seconds") - F.coalesce("held_seconds", F.lit(0))}
    out = out.withColumns({c: apart.otherwise(n) for c, n in others.items()}).withColumn("_told", told.scalar())
    out = out.withColumns({"warning_records": F.col("_told.n"), **{f"_{c}": F.col(f"_told.{c}") for c in ("interval", "polygon", "invalid")}})
    none, covered = F.col("warning_records") == 0, F.coalesce("point_warning_interval_count", F.lit(0)) > 0
    missed = F.col("first").isNull()
    hit = [none, F.col("_interval"), F.col("_polygon"), F.col("_invalid"), ~covered & ~none, covered & missed, F.coalesce("late", F.lit(False)), missed, F.coalesce("false_alarm_interval_count", F.lit(0)) > 0]
    return out.select(
        "event",
        "event_time",
        "lat",
        "lon",
        "warning_records",
        zero("point_warning_records"),
        zero("event_warning_records"),
        zero("point_warning_interval_count"),
        zero("point_warning_duration_seconds"),
        F.col("first.record_key").alias("first_valid_warning_record_key"),
        F.col("first.warning_event_id").alias("first_valid_warning_event_id"),
        F.col("first.lead_start").alias("first_valid_warning_lead_start"),
        F.col("first.start").alias("first_valid_warning_interval_start"),
        F.col("first.end").alias("first_valid_warning_interval_end"),
        times.seconds(F.col("first.lead_start"), F.col("event_time")).alias("lead_time_seconds"),
        missed.alias("missed_event"),
        zero("false_alarm_interval_count"),
        zero("false_alarm_duration_seconds"),
        F.array_compact(F.array(*(F.when(h, F.lit(f)) for h, f in zip(hit, FLAGS, strict=True)))).alias("quality_flags"),
    )


def _slicing(start: Column, end: Column) -> Column:
    """The slicing, in doublings of an hour, whose slices are no shorter than an interval."""
    return F.ceil(F.log2(F.greatest((F.unix_seconds(end) - F.unix_seconds(start)) / 3600, F.lit(1.0)))).cast("int")


def _slice(time: Column, slicing: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (3600 * F.pow(F.lit(2.0), slicing)))


def merged_intervals(spans: DataFrame, keys: list[str], days: int = 1) -> DataFrame:
    """Intervals (start, end) of each key, those that overlap or touch made one.

    Islands are formed among the intervals that begin in the same slice of `days`, then islands of neighbouring slices are
    joined. So a key with a large share of all intervals is many tasks' work, and its second step orders islands only, of which a
    slice leaves one unless nothing was in effect between.
    """
    slice_ = F.floor(F.unix_seconds("start") / (86_400 * days)).alias("_slice")
    spans = spans.select(*keys, "start", "end", slice_).distinct()
    return _islands(_islands(spans, [*keys, "_slice"]), keys)


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    island = fresh.withColumn("_island", F.sum("_new").over(by_start))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


# --- pairs


def pair_metrics(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Overlap in time and area of pairs of timeline records, given as two struct columns. Works within each row. Records that
    have a `shape` bring what was found once for each of them; it is found for each pair otherwise."""
    (a, b_), (c, d) = interval(f"{left}."), interval(f"{right}.")
    sides = {"_one": left, "_other": right}
    ready = "shape" in pairs.schema[left].dataType.names
    if not ready:
        pairs = pairs.withColumns({k: geometry.shape(F.col(f"{side}.polygon")) for k, side in sides.items()})
    one, other = (F.col(f"{side}.shape") if ready else F.col(k) for k, side in sides.items())
    out = pairs.select(
        F.col(f"{left}.record_key").alias("left_record_key"),
        F.col(f"{right}.record_key").alias("right_record_key"),
        F.col(f"{left}.event_id").alias("left_event_id"),
        F.col(f"{right}.event_id").alias("right_event_id"),
        a.alias("left_interval_start"),
        b_.alias("left_interval_end"),
        c.alias("right_interval_start"),
        d.alias("right_interval_end"),
        geometry.area_of(one).alias("left_area_square_degrees"),
        geometry.area_of(other).alias("right_area_square_degrees"),
        geometry.shared_area(one, other).alias("polygon_overlap_area_square_degrees"),
    )
    span = lambda side: times.seconds(F.col(f"{side}_interval_start"), F.col(f"{side}_interval_end"))
    shared = times.overlap_seconds(*(F.col(f"{side}_interval_{end}") for side in ("left", "right") for end in ("start", "end")))
    out = out.withColumns({"left_duration_seconds": span("left"), "right_duration_seconds": span("right"), "time_overlap_seconds": shared})
    out = out.withColumn("time_union_seconds", F.col("left_duration_seconds") + F.col("right_duration_seconds") - F.col("time_overlap_seconds"))
    area = {side: F.col(f"{side}_area_square_degrees") for side in ("left", "right")}
    both = F.col("polygon_overlap_area_square_degrees")
    out = out.withColumns(
        {
            "time_overlap_ratio": geometry.share(F.col("time_overlap_seconds"), F.col("time_union_seconds"), 0),
            "polygon_union_area_square_degrees": geometry.nonnegative(area["left"] + area["right"] - both),
            "left_area_time_square_degree_seconds": area["left"] * F.col("left_duration_seconds"),
            "right_area_time_square_degree_seconds": area["right"] * F.col("right_duration_seconds"),
            "overlap_area_time_square_degree_seconds": both * F.col("time_overlap_seconds"),
        }
    )
    out = out.withColumn("polygon_overlap_ratio", geometry.share(both, F.col("polygon_union_area_square_degrees")))
    whole = geometry.nonnegative(F.col("left_area_time_square_degree_seconds") + F.col("right_area_time_square_degree_seconds") - F.col("overlap_area_time_square_degree_seconds"))
    out = out.withColumn("union_area_time_square_degree_seconds", whole)
    return out.withColumn("area_time_overlap_ratio", geometry.share(F.col("overlap_area_time_square_degree_seconds"), F.col("union_area_time_square_degree_seconds")))


#: Columns of records that pair_metrics() reads besides their shape.
MEASURED = ("record_key", "event_id", "issued_at", "wrapper_issue", "valid_start", "valid_end", "expires_at", "canceled_at")


def overlapping_pairs(rows: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs (left, right; the smaller record key is left) of records of different events whose intervals and boxes overlap.
    columns: of the records that their pairs are to have, all unless told.

    Boxes have a home grid, the finest whose cells are no smaller, and intervals a home slicing likewise, so each record has at most
    four cells and two slices at home; a world-wide or year-long one as well. It is shown on the coarser grids and slicings that
    are some record's home too, and a pair meets where the coarser home of each kind is: one equi-join for records at home on
    both, one for a wide short record and a small long one. Of the cells and slices that a pair shares, the one
    that holds the lower corner of its overlap gives the pair, so pairs come out once without a grouping. Only records
    with a valid ring take part. The join moves records with their columns, a few copies of each, and pairs, which can be many more than
    records, come out of it complete: nothing behind it moves them. Records have their `shape`, which pair_metrics() takes.
    """
    start, end = interval()
    own = rows.withColumn("shape", geometry.shape(F.col("polygon"))).withColumns({"_start": start, "_end": end, "_ring": geometry.solid(F.col("shape"))}).withColumn("_box", geometry.box(F.col("_ring")))
    own = own.withColumns({"_number": F.monotonically_increasing_id(), **{f"_{c}": F.col(f"_box.{c}") for c in ("south", "north", "west", "east")}, "_grid": F.ceil(F.log2(F.greatest(F.col("_box.north") - F.col("_box.south"), F.col("_box.east") - F.col("_box.west"), F.lit(1.0)))).cast("int"), "_slicing": _slicing(F.col("_start"), F.col("_end"))})
    # Those that do not take part are left out behind the table: a filter before it would find shapes and intervals a second time.
    names = [c for c in rows.columns if columns is None or c in columns]
    inner = [c for c in own.columns if c[0] == "_" and c not in ("_ring", "_box")]
    own = settled(own.select(*{*names, "record_key", "event_id"}, "shape", *inner), "warnings").where("_start is not null and _south is not null")
    # Homes are few whatever the number of records: 9 grids, and a slicing for each doubling of an hour.
    homes = own.select("_grid", "_slicing").distinct()
    grids, slicings = (homes.select(F.col(c).alias(f"{c}_")).distinct() for c in ("_grid", "_slicing"))
    shown = own.join(F.broadcast(grids), F.col("_grid_") >= F.col("_grid")).join(F.broadcast(slicings), F.col("_slicing_") >= F.col("_slicing"))
    side = F.pow(F.lit(2.0), F.col("_grid_"))
    between = lambda low, high, unit: F.sequence(F.floor(low / unit), F.floor(high / unit))
    cells = {"_y": between(F.col("_south"), F.col("_north"), side), "_x": between(F.col("_west"), F.col("_east"), side), "_t": F.sequence(_slice(F.col("_start"), F.col("_slicing_")), _slice(F.col("_end"), F.col("_slicing_")))}
    for c, every in cells.items():
        shown = shown.select("*", F.posexplode(every).alias(f"{c}0", c))
    home_grid, home_slicing = F.col("_grid") == F.col("_grid_"), F.col("_slicing") == F.col("_slicing_")
    # The first cell of a record has its own lower corner, in each of three ways. A pair's overlap has its lower corner where either record has.
    corner = sum((F.when(F.col(f"{c}0") == 0, 1 << i).otherwise(0) for i, c in enumerate(cells)), F.lit(0))
    # Records at home meet twice there, and count once; where one of them is not, they meet once.
    rank = F.when(home_grid & home_slicing, F.col("_number")).otherwise((1 << 63) - 1)
    shown = shown.withColumns({"_corner": corner, "_home": home_grid & home_slicing, "_rank": rank})
    names.append("shape")

    def met(one: DataFrame, other: DataFrame, once: Column) -> DataFrame:
        a, b_ = one.alias("a"), other.alias("b")
        # A cell's rows are compared by few numbers, as what the join compares it reads for each two of them, and most are no pair.
        on = (F.col("a._start") < F.col("b._end")) & (F.col("b._start") < F.col("a._end")) & once
        for low, high in (("_south", "_north"), ("_west", "_east")):
            on = on & (F.col(f"a.{low}") <= F.col(f"b.{high}")) & (F.col(f"b.{low}") <= F.col(f"a.{high}"))
        on = on & (F.col("a._corner").bitwiseOR(F.col("b._corner")) == 7)
        for c in ("_t", "_y", "_x", "_slicing_", "_grid_"):  # sorted so, what differs most first
            on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        # Texts are compared behind the join: a condition that is not deterministic stays there.
        apart = F.when(F.monotonically_increasing_id() >= 0, F.col("a.event_id") != F.col("b.event_id"))
        found = a.join(b_, on).where(apart).select(*(F.col(f"{p}.{c}").alias(f"_{p}_{c}") for p in "ab" for c in names), (F.col("a.record_key") < F.col("b.record_key")).alias("_ordered"))
        # Which side is left is chosen field by field and once for each, so that columns which nobody asks for are left out before the join.
        sides = {"left": ("_a_", "_b_"), "right": ("_b_", "_a_")}
        found = found.select(*(F.when(F.col("_ordered"), F.col(p + c)).otherwise(F.col(q + c)).alias(f"_{k}_{c}") for k, (p, q) in sides.items() for c in names))
        return found.select(*(F.struct(*(F.col(f"_{k}_{c}").alias(c) for c in names)).alias(k) for k in sides))

    pairs = met(shown.where(F.col("_home")), shown, F.col("a._number") < F.col("b._rank"))
    return pairs.unionByName(met(shown.where(home_grid & ~home_slicing), shown.where(~home_grid & home_slicing), F.lit(True)))


# --- counts


def scan_counts(inputs: DataFrame) -> DataFrame:
    """Files and messages by input kind and transport. inputs: messages from sources.messages(), parsed."""
    good = inputs.where(F.col("error_kind").isNull())
    return good.groupBy("input_kind", "transport").agg(F.count_distinct("path").alias("files"), F.count("*").alias("messages"))


def family_counts(known: DataFrame) -> DataFrame:
    return known.where(F.col("error_kind").isNull()).groupBy("family").agg(F.count("*").alias("messages"))


def error_counts(known: DataFrame) -> DataFrame:
    return known.where(F.col("error_kind").isNotNull()).groupBy("error_kind", "error_field").agg(F.count("*").alias("messages"))


def totals(inputs: DataFrame) -> DataFrame:
    """One row: scanned and parsed files, messages, failed files."""
    bad = F.col("error_kind").isNotNull()
    by_path = inputs.groupBy("path").agg(F.max(bad).alias("bad"), F.count(F.when(~bad, 1)).alias("n"))
    return by_path.agg(F.count("*").alias("scanned_files"), F.count(F.when(~F.col("bad"), 1)).alias("parsed_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count(F.when(F.col("bad"), 1)).alias("failures"))
