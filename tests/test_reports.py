"""Pairs and islands against brute force with wide, long and hot records; verbs, command line and parser edge cases."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest


from wxlake import __main__ as command
from wxlake import api
from wxlake.functions import tags
from wxlake.operators import archive, reports
from wxlake.sources import stanza

RECORD = "record_key string, event_id string, valid_start timestamp, valid_end timestamp, expires_at timestamp, canceled_at timestamp, issued_at timestamp, wrapper_issue timestamp, polygon array<struct<lat float, lon float>>"
DAY = datetime(2024, 1, 20)


def record(i, box, start, minutes, event=None):
    south, west, north, east = map(float, box)
    begin = DAY + timedelta(minutes=start)
    ring = [(south, west), (south, east), (north, east), (north, west)]
    return (f"k{i:04}", event or f"e{i}", begin, begin + timedelta(minutes=minutes), None, None, begin, None, ring)


def test_pairs_equal_all_pairs(spark):
    r = random.Random(1)
    rows = []
    for i in range(220):
        wide, long = r.choice([(0.3, 60), (0.3, 60), (2, 200), (9, 60), (60, 5000), (0.3, 400_000)]), r.random()
        south, west = r.uniform(-60, 20), r.uniform(-170, 60)
        if long < 0.5:  # many around one place and time
            south, west = 30 + r.uniform(0, 1), -90 + r.uniform(0, 1)
        rows.append(record(i, (south, west, south + wide[0], west + wide[0]), r.randrange(0, 4000) if long < 0.5 else r.randrange(-50_000, 50_000), r.randrange(1, wide[1]), f"e{i % 150}"))
    rows.append(record(900, (-80, -179, 80, 179), -900_000, 2_000_000))  # world-wide for years
    got = sorted((p.left.record_key, p.right.record_key) for p in reports.overlapping_pairs(spark.createDataFrame(rows, RECORD)).collect())
    import numpy as np

    flat = [(k, e, s, z, *(float(np.float32(v)) for v in (ring[0][0], ring[0][1], ring[2][0], ring[2][1]))) for k, e, s, z, *_, ring in rows]
    want = [(a[0], b[0]) for i, a in enumerate(flat) for b in flat[i + 1 :] if a[1] != b[1] and a[2] < b[3] and b[2] < a[3] and a[4] <= b[6] and b[4] <= a[6] and a[5] <= b[7] and b[5] <= a[7]]
    assert got == sorted(tuple(sorted(p)) for p in want) and len(got) > 1000


def test_a_hot_cell_yields_each_pair_once(spark):
    """Half of all boxes on one place."""
    r = random.Random(2)
    rows = [record(i, (30, -90, 30.2, -89.8) if i % 2 else (s := r.uniform(-60, 60), w := r.uniform(-170, 170), s + 0.2, w + 0.2), i * 7 if i % 2 else r.randrange(10_000), 30) for i in range(600)]
    pairs = reports.overlapping_pairs(spark.createDataFrame(rows, RECORD))
    hot = pairs.where("left.valid_start < right.valid_start").count()
    assert hot == pairs.distinct().count() >= 597  # each hot box meets the two before it


def test_islands_equal_a_plain_sweep(spark):
    r = random.Random(3)
    spans = [(p, s := r.randrange(0, 20_000), s + r.choice([1, 30, 90, 4000])) for p in (1, 1, 1, 2, 3) for _ in range(120)]
    at = lambda m: DAY + timedelta(minutes=m)
    rows = spark.createDataFrame([(p, at(s), at(z)) for p, s, z in spans], "event int, start timestamp, end timestamp")
    got = sorted((x.event, x.start, x.end) for x in reports.merged_intervals(rows, ["event"]).collect())
    want: list = []
    for p, s, z in sorted(spans):
        if want and want[-1][0] == p and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], z)
        else:
            want.append([p, s, z])
    assert got == [(p, at(s), at(z)) for p, s, z in want]


def test_winds_that_do_not_fit_give_way():
    assert tags.of_line("WIND...70000MPH MAX WIND GUST...60 MPH") == [("wind_mph", 60.0, None)]
    assert tags.of_line("WIND...70000MPH") == [] and tags.of_line("WIND...65535MPH")[0][1] == 65535.0


def test_stanzas_keep_every_character():
    body = "A\r\r\nB&lt;\r"
    text = f"<?xml version='1.0'?>\r\n<message><x xmlns='nwws-oi' cccc='KAAA' ttaaii='NOUS41' issue='2024-01-20T15:30:00Z' awipsid='P' id='7.1'>{body}.<![CDATA[c\r\r\nd]]></x></message>\r\n"
    assert stanza.read(text)["payload"]["raw"] == "A\r\r\nB<\r.c\r\r\nd"


def test_repeated_rows_import_and_deduplicate_once(spark):
    text = "NOUS41 KAAA 201530\nPNSAAA\n\nTEXT\n"
    rows = spark.createDataFrame([("a", 1, text), ("a", 1, text), ("b", 1, text), ("b", 1, text.replace("TEXT", "OTHER"))], "path string, message_index int, raw string")
    known = reports.parsed(rows)
    assert sorted(x.action for x in archive.imported(known).collect()) == ["archived", "archived", "duplicate", "duplicate"]
    assert archive.first_of_each(archive.fingerprinted(known)).count() == 2


def test_verbs(spark, tmp_path):
    text = "NOUS41 KAAA 201530\nPNSAAA\n\nTEXT\n"
    assert [x.heading for x in api.inspect_bytes(spark, b"\x01\r\r\n" + text.encode() + b"\x03").collect()] == ["NOUS41 KAAA 201530"]
    assert api.parse_bulletin(spark, text).first().awips_id == "PNSAAA" and api.parse_bulletin(spark, "x").first().error_kind
    assert api.parse_oi(spark, "<message from='a'/>").first().sender == "a"
    (tmp_path / "a.sbn").write_bytes(b"\x01\r\r\n" + text.encode() + b"\x03\x01bad\x03")
    assert api.write_pid201_split(spark, str(tmp_path / "a.sbn"), str(tmp_path / "out")).first().name == "00001_0_NOUS41_PNSAAA.txt"
    assert [x.path for x in api.input_failures(spark, str(tmp_path / "a.sbn")).collect()] == ["a.sbn"]


def test_command_line_prints_all_rows_or_none(spark, tmp_path, capsys):
    (tmp_path / "a.sbn").write_bytes(b"".join(b"\x01\r\r\nNOUS41 KAAA 201530\nPNSAAA\n\nTEXT %d\n\x03" % i for i in range(30)))
    source = str(tmp_path / "a.sbn")
    command.main(["inspect", source, "--format", "jsonl", "--most", "5"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 30
    command.main(["inspect", source, "--format", "json", "--most", "5"], spark)
    assert len(json.loads(capsys.readouterr().out)) == 30
    for form, error in (("text", SystemExit), ("tool-result", ValueError)):
        with pytest.raises(error, match="more than 5"):
            command.main(["inspect", source, "--format", form, "--most", "5"], spark)


def test_readers_survive_a_compaction(spark, tmp_path):
    path = str(tmp_path / "archive")
    text = "NOUS41 KAAA 201530\nPNSAAA\n\nTEXT {}\n"
    for i in range(6):
        rows = spark.createDataFrame([(f"p{i}", 1, text.format(i), DAY + timedelta(days=i % 2))], "path string, message_index int, raw string, at timestamp")
        archive.write(archive.stored(archive.fingerprinted(reports.parsed(rows)), "feed", rows["at"]), path)
    names = lambda df: sorted(x.source_path for x in df.select("source_path").collect())
    every = [f"p{i}" for i in range(6)]
    early = archive.current(spark, path)
    files = len(early.inputFiles())
    assert archive.compact(spark, path, "2024-01-20") == 3 and archive.compact(spark, path, "2024-01-20") == 0 and archive.compact(spark, path, "2030-01-01") == 0
    assert names(early) == every == names(archive.current(spark, path))  # one that was planned before, and one after
    day = tmp_path / "archive" / "capture_date=2024-01-21"
    left = next(day.rglob("*.parquet"))
    (left.parent / "compacted-abc-00000.parquet").write_bytes(left.read_bytes())  # an unfinished compaction
    assert names(archive.current(spark, path)) == every
    assert archive.vacuum(spark, path) == 4 and names(archive.current(spark, path)) == every
    assert archive.compact(spark, path, "2024-01-21") == 3 and archive.vacuum(spark, path) == 3
    assert names(archive.current(spark, path)) == every == names(spark.read.parquet(path)) and files == 6
