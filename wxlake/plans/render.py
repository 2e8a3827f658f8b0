"""Bulletins rendered from the `events` table, so that queries parse real text whose facts SQL knows independently.

Every event is one message of a warning's life. A user's events of one type form warnings of four messages each:
NEW, CON, EXT, then CAN or EXP. Separators, identifiers, second segments, hydrologic codes, tags and five kinds of
malformed messages follow from the event's id, as stated beside each column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread

PHENOMENA = {"error": "TO", "click": "SV", "purchase": "FF", "view": "FL", "signup": "MA"}
IDENTIFIERS = {"error": "TOR", "click": "SVR", "purchase": "FFW", "view": "FLS", "signup": "MWW"}
STATES = ("IL", "TX", "KS", "OK")


def _of(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), key)


def _letters(n: Column) -> Column:
    """Three letters of a number in base 26."""
    letter = lambda x: F.char((x % 26 + 65).cast("int"))
    return F.concat(letter(F.floor(n / 676)), letter(F.floor(n / 26)), letter(n))


def _digits(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def facts(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """What each message says, one row an event. dealt: over all tasks, as the lives of the warnings come out of a shuffle."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    life = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = e.withColumn("n", F.row_number().over(life) - 1)
    e = spread(e) if dealt else e  # few numbers a row here, a text later
    step, etn = F.col("n") % 4, F.floor(F.col("n") / 4).cast("int") + 1
    e = e.withColumns({"etn": etn, "step": step})
    last = F.when(F.col("etn") % 2 == 0, "CAN").otherwise("EXP")
    issue = F.date_trunc("minute", "ts")
    first = (F.col("user_id") * 7 + F.col("etn") * 3) % 400 + 1
    subset = (F.col("etn") % 4 == 0) & (F.col("step") == 3)
    return e.withColumns(
        {
            "office": F.concat(F.lit("K"), _letters(F.col("user_id"))),
            "phenomenon": _of(F.col("event_type"), PHENOMENA),
            "action": F.when(F.col("step") == 0, "NEW").when(F.col("step") == 1, "CON").when(F.col("step") == 2, "EXT").otherwise(last),
            "issue": issue,
            "valid_end": F.timestamp_seconds(F.unix_seconds(issue) + (30 + F.col("event_id") % 90) * 60),
            "state": F.element_at(F.array(*map(F.lit, STATES)), (F.col("user_id") % 4 + 1).cast("int")),
            "zone": F.col("etn") % 5 == 0,
            "first": first,
            "many": F.when(subset, 1).otherwise(F.col("etn") % 4 + 1),
            "lat": 3000 + F.col("user_id") % 150 * 10,
            "lon": 8000 + F.col("user_id") % 200 * 10,
            "size": 5 + F.col("event_id") % 40,
            "bad": F.when(F.col("event_id") % 11 == 0, F.floor(F.col("event_id") / 11) % 5).otherwise(-1),
            "path": F.concat(F.lit("src/"), _digits(F.col("event_id"), 9), F.lit(".txt")),
        }
    )


def texts(facts: DataFrame, *more: str | Column) -> DataFrame:
    """path, message_index and raw of each message, and further facts."""
    time = lambda c: F.date_format(c, "yyMMdd'T'HHmm'Z'")
    heading = F.concat(F.lit("WUUS53 "), F.col("office"), F.lit(" "), F.date_format("issue", "ddHHmm"), F.when(F.col("event_id") % 5 == 0, " AAA").otherwise(""), F.lit("\n"))
    sequence = F.when(F.col("event_id") % 2 == 0, F.concat(_digits(F.col("event_id") % 1000, 3), F.lit("\n"))).otherwise("")
    awips = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(_of(F.col("event_type"), IDENTIFIERS), F.substring("office", 2, 3), F.lit("\n")))
    purge = F.concat(F.date_format("valid_end", "ddHHmm"), F.lit("-"))
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda i: F.concat(_digits(F.col("first") + i * 2, 3), F.lit("-"))), "")
    rest = F.when(F.col("zone"), F.concat(_digits(F.col("first"), 3), F.lit(">"), _digits(F.col("first") + F.col("many") + 1, 3), F.lit("-"))).otherwise(numbers)
    kind = F.when(F.col("zone"), "Z").otherwise("C")
    good = F.concat(F.col("state"), kind, rest)
    # Kind 2 writes a range of counties, kind 3 names a state a second time.
    ugc = F.concat(F.when(F.col("bad") == 2, F.concat(F.col("state"), F.lit("C001>003-"))).when(F.col("bad") == 3, F.concat(F.col("state"), F.lit("C001-NDC005-"), F.col("state"), F.lit("C007-"))).otherwise(good), purge)
    # Kind 0 has an unknown phenomenon, kind 1 ends on 31 April.
    end = F.when(F.col("bad") == 1, "240431T1200Z").otherwise(time("valid_end"))
    start = F.when(F.col("step") == 0, time("issue")).otherwise("000000T0000Z")
    code = F.concat(F.lit("/O."), F.col("action"), F.lit("."), F.col("office"), F.lit("."), F.when(F.col("bad") == 0, "QQ").otherwise(F.col("phenomenon")), F.lit(".W."), _digits(F.col("etn"), 4), F.lit("."), start, F.lit("-"), end, F.lit("/\n"))
    hydro = F.when(F.col("phenomenon") == "FL", F.concat(F.lit("/"), F.substring("office", 2, 3), F.lit("I2.2.ER."), time("issue"), F.lit(".000000T0000Z."), time("valid_end"), F.lit(".NO/\n"))).otherwise("")
    corner = lambda a, b: F.concat(F.lit(" "), _digits(F.col("lat") + a, 4), F.lit(" "), F.when(F.col("lon") + b >= 10000, _digits(F.col("lon") + b, 5)).otherwise(_digits(F.col("lon") + b, 4)))
    none, size = F.lit(0), F.col("size")
    # Kind 4 lacks the last longitude.
    polygon = F.concat(F.lit("LAT...LON"), corner(none, none), corner(none, size), F.lit("\n     "), corner(size, size), F.when(F.col("bad") == 4, F.concat(F.lit(" "), _digits(F.col("lat") + size, 4))).otherwise(corner(size, none)), F.lit("\n"))
    motion = F.concat(F.lit("TIME...MOT...LOC "), F.date_format("issue", "HHmm"), F.lit("Z "), _digits(F.col("event_id") % 361, 3), F.lit("DEG "), (F.col("event_id") % 60).cast("string"), F.lit("KT"), corner(none, size), F.lit("\n"))
    cents = F.col("event_id") % 400
    hail = F.concat(F.lit("MAX HAIL SIZE..."), F.floor(cents / 100).cast("string"), F.lit("."), _digits(cents % 100, 2), F.lit(" IN\n"))
    wind = F.concat(F.lit("MAX WIND GUST..."), (40 + F.col("event_id") % 60).cast("string"), F.lit(" MPH\n"))
    tags = F.when(F.col("event_id") % 3 == 0, F.concat(hail, wind)).otherwise("")
    tornado = F.when(F.col("phenomenon") == "TO", F.when(F.col("event_id") % 2 == 0, "TORNADO...OBSERVED\n").otherwise("TORNADO...RADAR INDICATED\n")).when((F.col("phenomenon") == "FF") & (F.col("event_id") % 2 == 0), "FLASH FLOOD DAMAGE THREAT...CATASTROPHIC\n").otherwise("")
    second = F.when(F.col("event_id") % 7 == 0, F.concat(F.col("state"), F.lit("C"), _digits(F.col("first") + 50, 3), F.lit("-"), purge, F.lit("\n/O.NEW."), F.col("office"), F.lit(".WI.Y."), _digits(F.col("etn"), 4), F.lit("."), time("issue"), F.lit("-"), time("valid_end"), F.lit("/\n\nWIND ADVISORY\n&&\n$$\n"))).otherwise("")
    text = F.concat(sequence, heading, awips, F.lit("\n"), ugc, F.lit("\n"), code, hydro, F.lit("\nWARNING "), F.col("event_id").cast("string"), F.lit(" IN EFFECT\n\n"), polygon, motion, tornado, tags, F.lit("\n$$\n"), second)
    separator = F.when(F.col("event_id") % 3 == 0, "\n").when(F.col("event_id") % 3 == 1, "\r\n").otherwise("\r\r\n")
    return facts.select("event_id", "path", F.lit(1).alias("message_index"), F.replace(text, F.lit("\n"), separator).alias("raw"), *more)


def placed_by_office(facts: DataFrame) -> DataFrame:
    """The facts with polygons placed by office. Offices are three letters, so of 17,576 users and more some share one, and the ids of
    its warnings as well; in place of two far polygons under one id, all of an id then have the same corner."""
    office = F.col("user_id") % 26**3
    return facts.withColumns({"lat": 3000 + office % 150 * 10, "lon": 8000 + office % 200 * 10})


def messages(spark: SparkSession, sf_dir: str, *more: str | Column) -> DataFrame:
    """The messages of all events, dealt over all tasks, and further facts of them."""
    return texts(facts(spark, sf_dir, dealt=True), *more)


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message in a stanza: path and content. Every 19th names another office, every 23rd lacks its number."""
    from ..sources import stanza

    e = facts(spark, sf_dir)
    another = F.when(F.col("office") == "KZZZ", "KZZY").otherwise("KZZZ")  # tables of 17,576 users and more have that office
    office = F.when(F.col("event_id") % 19 == 0, another).otherwise(F.col("office"))
    wrapper = F.struct(F.lit("groupchat").alias("type"), F.lit("nwws@host").alias("sender"), F.lit(None).cast("string").alias("recipient"), F.concat(F.lit("<"), F.col("event_id"), F.lit("> & 'more'")).alias("summary"), F.lit(None).cast("string").alias("xhtml_summary"), office.alias("cccc"), F.lit("WUUS53").alias("ttaaii"), F.lit("ANY").alias("awips"))
    number = F.when(F.col("event_id") % 23 == 0, "no.number").otherwise(F.concat_ws(".", F.lit("7"), F.col("event_id").cast("string")))
    at = F.timestamp_seconds(F.unix_seconds("issue") + 90)
    meta = e.select(F.col("path").alias("p"), wrapper.alias("wrapper"), number.alias("number"), at.alias("at"))
    rows = texts(e).join(meta, F.col("path") == F.col("p"))
    return rows.select(F.replace("path", F.lit(".txt"), F.lit(".xml")).alias("path"), F.encode(stanza.written(F.col("wrapper"), F.col("number"), F.col("at"), F.col("raw")), "UTF-8").alias("content"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulletin for each event: of the identifiers of the code tables, two-letter beginnings and titles it has the one at the
    event's id modulo their number."""
    from ..functions import codes

    named = [(c, None) for own in codes.PRODUCT_FAMILIES.values() for c in own.split()] + [(f"{p}Q", None) for p in codes.PREFIX_FAMILIES] + [("QQQ", None)]
    plain = [(None, t) for t in [*(f"A {x.lower()} for us" for x in codes.TITLE_FAMILIES), "NOTHING KNOWN"]]
    kinds = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(named + plain)], "kind int, nnn string, title string")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % (len(named) + len(plain))).cast("int").alias("kind"))
    rows = e.join(F.broadcast(kinds), "kind")  # the code tables, some 260 rows
    text = F.concat(F.lit("NOUS41 KAAA 201530\n"), F.coalesce(F.concat("nnn", F.lit("AAA\n")), F.lit("")), F.lit("\n"), F.coalesce("title", F.lit("PLAIN TEXT")), F.lit("\n"))
    return rows.select(F.concat(F.lit("p/"), _digits(F.col("event_id"), 9)).alias("path"), F.lit(1).alias("message_index"), text.alias("raw"))


#: Contents of files whose ending tells nothing.
SNIFFED = ("NOUS41 KAAA 201530\nPNSAAA\n\nTEXT\n", " \n<message to='a'/>", "<x xmlns='nwws-oi'/>", '<?xml version="1.0"?><y xmlns="nwws-oi"/>', "<other/>", "\x01abc\x03", "junk\x01abc\x03", "a\x03b\x01c", "\x01 only", "text \x01 later")


#: Corners of rings, in steps of a tenth of a degree: a square, an L, one that crosses itself, a triangle, and a line.
RINGS = {
    "square": [(0, 0), (0, 4), (4, 4), (4, 0)],
    "bend": [(0, 0), (0, 4), (2, 4), (2, 2), (4, 2), (4, 0)],
    "crossed": [(0, 0), (4, 4), (0, 4), (4, 0)],
    "triangle": [(0, 0), (0, 4), (4, 0)],
    "line": [(0, 0), (4, 4), (0, 0)],
}


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon for each event: its shape in turn, moved by the user's place; closed ones repeat the first corner."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 100).cast("int").alias("at"))
    shapes = [F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in corners)) for corners in RINGS.values()]
    corners = F.element_at(F.array(*shapes), (F.col("event_id") % len(RINGS) + 1).cast("int"))
    corners = F.when(F.col("event_id") % 2 == 0, F.concat(corners, F.slice(corners, 1, 1))).otherwise(corners)
    degrees = lambda step, base: ((step + F.col("at")) / 10 + base).cast("float")
    points = F.transform(corners, lambda c: F.struct(degrees(c["y"], 30).alias("lat"), degrees(c["x"], -90).alias("lon")))
    return e.select("event_id", "at", F.element_at(F.array(*map(F.lit, RINGS)), (F.col("event_id") % len(RINGS) + 1).cast("int")).alias("shape"), points.alias("polygon"))


def streams(messages: DataFrame) -> DataFrame:
    """Framed byte streams of neighbouring messages: path and content. Stream i holds the messages of ids 20 i to
    20 i + 19 with three bytes of junk before the first, one before every fifth, and an open frame after the last."""
    stream = F.floor(F.col("event_id") / 20)
    frame = F.concat(F.when(F.col("event_id") % 20 % 5 == 0, "~").otherwise(""), F.lit("\x01\r\r\n"), F.col("raw"), F.lit("\x03"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("frame")))), lambda x: x["frame"]), "")
    out = messages.groupBy(stream.alias("stream")).agg(F.concat(F.lit("<<<"), joined, F.lit("\x01\r\r\nOPEN")).alias("text"))
    return out.select("stream", F.concat(F.lit("streams/"), _digits(F.col("stream"), 9), F.lit(".sbn")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def stanza_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML streams of neighbouring messages: stream (50 events each) and content. A head opens each; before every third stanza there
    is a presence, before every seventh a comment that names a tag, and a stanza without a bulletin follows every eleventh."""
    rows = wrapped(spark, sf_dir).withColumn("event_id", F.substring("path", 5, 9).cast("long"))
    more = lambda k, text: F.when(F.col("event_id") % k == 0, text).otherwise("")
    own = F.concat(more(3, "<presence from='a>b'/>"), more(7, "<!-- <message> -->"), F.decode("content", "UTF-8"), more(11, "<message type='chat'><body>none</body></message>"), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", own.alias("t")))), lambda x: x["t"]), "")
    out = rows.groupBy(F.floor(F.col("event_id") / 50).alias("number")).agg(joined.alias("text"))
    head = F.lit("<?xml version='1.0'?><stream:stream xmlns:stream='http://etherx.jabber.org/streams'>")
    return out.select(F.concat(F.lit("xmpp/"), _digits(F.col("number"), 9)).alias("stream"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
