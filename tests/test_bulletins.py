"""Bulletins, reports and sources against worked examples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wxlake import __main__ as command
from wxlake import api
from wxlake.functions import geometry, hashing, segmenter, tags, times, wire
from wxlake.operators import archive, reports, summaries
from wxlake.sources import files, stanza
from wxlake.streaming import frames, jobs

TORNADO = """518
WUUS53 KWXY 061210
TORWXY

NEC011-025-211-061255-
/O.NEW.KWXY.TO.W.0007.270506T1210Z-270506T1255Z/

TORNADO WARNING FOR THE VALLEY
LAT...LON 4110 9820 4110 9760 4080 9760 4080 9820
TIME...MOT...LOC 1210Z 241DEG 22KT 4095 9800
TORNADO...OBSERVED
MAX HAIL SIZE...1.125 IN

$$
"""
UPDATE = """519
WWUS73 KWXY 061230
SVSWXY

NEC011-025-211-061255-
/O.CON.KWXY.TO.W.0007.000000T0000Z-270506T1255Z/

LAT...LON 4110 9820 4110 9760 4080 9760 4080 9820

$$

NEC031-047-061320-
/O.NEW.KWXY.SV.W.0011.270506T1230Z-270506T1320Z/

LAT...LON 4110 9820 4110 9760 4080 9760 4080 9820

$$
"""


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([("a.txt", 1, TORNADO), ("b.txt", 1, UPDATE)], "path string, message_index int, raw string")


def test_active_at(two):
    at = lambda t: [(r.event_family, r.action) for r in reports.active_at(two, f"2027-05-06T{t}:00Z").collect()]
    assert sorted(at("12:40")) == [("severe-thunderstorm", "NEW"), ("tornado", "CON")]
    assert at("12:20") == [("tornado", "NEW")]
    assert at("13:20") == []


def test_timeline_and_lead_time(spark, two):
    rows = reports.timeline(two, "2027-05-06T12:40:00Z")
    got = {(r.event_id[7:9], r.action): r for r in rows.collect()}
    assert {k: r.lifecycle_status for k, r in got.items()} == {("TO", "NEW"): "superseded", ("TO", "CON"): "active", ("SV", "NEW"): "active"}
    assert got["SV", "NEW"].ugcs == ["NEC031", "NEC047"] and got["TO", "CON"].valid_start is None
    assert got["TO", "NEW"].tags.hail_inches == pytest.approx(1.13) and got["TO", "NEW"].time_mot_loc.speed_knots == 22
    assert got["TO", "NEW"].polygon[0].lat == pytest.approx(41.10) and got["TO", "NEW"].polygon[0].lon == pytest.approx(-98.2)
    event = spark.createDataFrame([(1, "2027-05-06 12:25:00", 40.95, -98.0), (2, "2027-05-06 12:25:00", 10.0, 10.0)], "event int, t string, lat double, lon double").withColumn("event_time", F.to_timestamp("t"))
    lead = {r.event: r for r in reports.lead_times(reports.records(two, "2027-05-06T12:25:00Z"), event).collect()}
    assert not lead[1].missed_event and lead[1].lead_time_seconds == 900 and "TO.W.0007" in lead[1].first_valid_warning_event_id
    assert lead[2].missed_event and lead[2].quality_flags == ["no-point-warning-intervals", "missed-event"]


def test_headings():
    assert wire.read(None)["error_kind"] == "InvalidUtf8"
    assert wire.read("NOUS41 KABC 201530")["error_field"] == "wmo heading line"
    assert wire.read("NOUS41 KABC\nx\n")["error_field"] == "yygggg"
    assert wire.read("NOUS41 KABC 201530 AAA B\nx\n")["error_field"] == "wmo heading token count"
    assert wire.read("\x01abcd")["error_kind"] == "InvalidControl"
    good = wire.read("111\r\r\nNOUS41 KABC 201530 AAA\r\r\nTOR-XYZ\r\r\nbody\r\r\n")
    assert (good["sequence_number"], good["bbb"], good["awips_id"], good["body"]) == (111, "AAA", None, "TOR-XYZ\r\r\nbody")


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("NEC007-019-061255-", ["NEC007", "NEC019"]),
        ("NEZ001>003-COZ005-061255-", ["NEZ001", "NEZ002", "NEZ003", "COZ005"]),
        ("NECALL-061255-", ["NECALL"]),
        ("NEC001>003-061255-", None),
        ("NEC001-SDC001-NEC003-061255-", None),
        ("NEC019-007-061255-", None),
        ("NEC007-321255-", None),
        ("NEC007-SDZ001-061255-", None),
        ("007-061255-", None),
    ],
)
def test_areas(text, codes):
    assert segmenter.areas(text) == codes


def test_a_malformed_polygon_rejects_the_product():
    out = segmenter.parse(TORNADO.replace(" 4080 9820", " 4080"))
    assert (out["error_kind"], out["error_field"], out["parts"]) == ("InvalidField", "LAT...LON", None)
    assert segmenter.parse(TORNADO.replace("270506T1255Z", "270431T1255Z"))["parts"][0]["pvtec"] == []


def test_issue_time(spark):
    rows = [("010000", "2024-01-20 00:00:00", "2024-02-01 00:00:00"), ("312359", "2024-01-01 00:00:00", "2023-12-31 23:59:00"), ("310000", "2024-02-10 00:00:00", "2024-01-31 00:00:00"), ("012460", "2024-01-20 00:00:00", None)]
    df = spark.createDataFrame(rows, "g string, a string, want string")
    got = df.select(times.issue_time(F.col("g"), F.to_timestamp("a")).cast("string").alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_measurements_round_in_single_precision():
    assert [tags.hundredths(x) for x in ("1.125", "0.875", "1.00", "1.005", "-1.125")] == pytest.approx([1.13, 0.88, 1.0, 1.01, -1.13])
    assert tags.hundredths("1e39") is None
    assert tags.of_line("MAX HAIL SIZE...<1.125 IN") == [("hail_inches", pytest.approx(1.13), None)]


def test_frames_in_pieces():
    whole = b"~~\x01\r\r\na\x03~\x01\r\r\nbc\x03\x01open"
    for cut in range(len(whole) + 1):
        state, got = (b"", 0, 0), []
        for piece in (whole[:cut], whole[cut:]):
            found, *state = frames.push(*state, piece)
            got += found
        assert [(at, raw) for at, _, raw in got] == [(2, b"\x01\r\r\na\x03"), (9, b"\x01\r\r\nbc\x03")]
        assert tuple(state) == (b"\x01open", 16, 3)


def test_backoff_and_supervision():
    assert [jobs.backoff(n, draw=lambda: 1.0) for n in (0, 1, 5, 9)] == [1, 2, 32, 60] and jobs.backoff(3, draw=lambda: 0.0) == 4

    class Query:
        lastProgress = None

        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("lost")

    waits = []
    assert jobs.supervised(lambda n: Query(n < 3), sleep=waits.append, draw=lambda: 1.0) == 4 and waits == [1, 2, 4]
    with pytest.raises(RuntimeError):
        jobs.supervised(lambda n: Query(True), tries=2, sleep=waits.append)


def test_counters_and_envelope(spark, two, tmp_path):
    counters = jobs.Counters()
    spark.streams.addListener(counters)
    two.withColumn("received_at", F.current_timestamp()).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("path string, message_index int, raw string, received_at timestamp").parquet(f"{tmp_path}/in")
    jobs.counted(reports.parsed(feed)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(counters)
    assert counters.n["received"] == counters.n["parsed"] == 2 and counters.n["rejected"] == 0 and counters.n["failures"] == 0
    said = json.loads(summaries.enveloped(reports.active_at(two, "2027-05-06T12:40:00Z").select("key"), "active-at", "records", {}, {}))
    assert said["tool_name"] == "warning.active_at_reference" and said["evidence"][0]["count"] == 2 == len(said["data"]["records"])
    assert summaries.tool_result("lead-time", {"missed_event": True}, {}, {})["evidence"][0]["missed_event"]


def test_verbs_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(TORNADO.encode())
    (tmp_path / "in" / "b.sbn").write_bytes(b"".join(b"\x01\r\r\n" + t.encode() + b"\x03" for t in (TORNADO, UPDATE)))
    source, store = str(tmp_path / "in"), str(tmp_path / "archive")
    first = {(r.path, r.message_index): r.action for r in api.archive_import(spark, source, store).collect()}
    assert first == {("a.txt", 1): "archived", ("b.sbn", 1): "duplicate", ("b.sbn", 2): "archived"}
    assert {r.action for r in api.archive_import(spark, source, store).collect()} == {"duplicate"}
    assert [r.status for r in api.archive_verify(spark, store).collect()] == ["ok", "ok"]
    assert api.collect_input_paths(spark, source) == ["a.txt", "b.sbn"]
    assert api.split_pid201(spark, f"{source}/b.sbn").count() == 2
    command.main(["active-at", source, "--at", "2027-05-06T12:40:00Z", "--format", "jsonl"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 2
    command.main(["lead-time", source, "--event-at", "2027-05-06T12:25:00Z", "--lat", "40.95", "--lon", "-98.0", "--format", "json"], spark)
    assert json.loads(capsys.readouterr().out)[0]["lead_time_seconds"] == 900


def test_hashes(spark):
    assert hashing.blake3_hex([b""]) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"]
    got = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(hashing.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def _square(x, y, size):
    return [(y, x), (y, x + size), (y + size, x + size), (y + size, x)]


def test_geometry(spark):
    rows = [(_square(0.0, 0.0, 2.0), _square(1.0, 1.0, 2.0)), ([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)], _square(0.0, 0.0, 1.0)), (_square(0.0, 0.0, 1.0), _square(5.0, 5.0, 1.0)), ([(0.0, 0.0)], None)]
    kind = "array<struct<lat:float,lon:float>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    got = df.select(geometry.area(F.col("a")), geometry.overlap_area(F.col("a"), F.col("b")), geometry.contains(F.col("a"), F.lit(1.0), F.lit(0.0)), geometry.contains(F.col("a"), F.lit(9.0), F.lit(9.0))).collect()
    assert [tuple(r) for r in got] == [(4.0, 1.0, True, False), (None, None, None, None), (1.0, 0.0, True, False), (None, None, None, None)]


def test_frames():
    frame = b"\x01\r\r\nx\x03"
    got = files.framed(b"junk" + frame + frame + b"tail")
    assert (len(got["chunks"]), got["junk"], got["pending"]) == (2, 4, 4) and got["chunks"][1]["start"] == 10
    assert files.framed(b"abc") == {"chunks": [], "junk": 3, "pending": 0}


def test_mixed_folder_and_import(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(TORNADO.encode())
    (tmp_path / "b.sbn").write_bytes(b"".join(b"\x01\r\r\n" + t.encode() + b"\x03" for t in (TORNADO, UPDATE)))
    body = TORNADO.replace("\n", "\r\r\n").replace("&", "&amp;")
    (tmp_path / "c.xml").write_bytes(f"<message type='groupchat'><body>x</body><x xmlns='nwws-oi' cccc='KWXY' ttaaii='WUUS53' issue='2027-05-06T12:10:00Z' awipsid='TORWXY' id='9.3'>{body}</x></message>".encode())
    (tmp_path / "d.xml").write_bytes(b"<message><x")
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "e.txt").write_bytes(b"skipped")
    known = files.inspected(files.messages(files.inputs(spark, str(tmp_path)))).cache()
    assert sorted((r.path, r.message_index, r.error_kind) for r in known.collect()) == [("a.txt", 1, None), ("b.sbn", 1, None), ("b.sbn", 2, None), ("c.xml", 1, None), ("d.xml", 1, "Input")]
    assert {r.input_kind: (r.files, r.messages) for r in reports.scan_counts(known).collect()} == {"bulletin": (1, 1), "framed_stream": (1, 2), "xml_stanza": (1, 1)}
    prints = {r.path: r.semantic_fingerprint for r in archive.fingerprinted(known.where("message_index = 1")).collect()}
    assert prints["a.txt"] == prints["b.sbn"]
    done = {(r.path, r.message_index): r.action for r in archive.imported(known).collect()}
    assert done["a.txt", 1] == "archived" and done["b.sbn", 1] == "duplicate" and done["b.sbn", 2] == "archived"


def test_stanzas_keep_their_line_ends():
    got = stanza.read("<message><x xmlns='nwws-oi' cccc='A' ttaaii='B' issue='2027-05-06T12:10:00Z' awipsid='C' id='7'>a\r\r\nb &amp; c<![CDATA[<\r\n>]]></x></message>")
    assert got["payload"]["raw"] == "a\r\r\nb & c<\r\n>" and got["payload"]["sequence"] == "7"
    assert stanza.read("<message><x xmlns='nwws-oi' id='x'>a</x></message>")["payload"] is None
