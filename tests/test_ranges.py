"""Framed streams read in byte ranges against the whole-file scanner."""

from __future__ import annotations

import random

import pytest

from wxlake.sources import files, ranges


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "300")
    yield spark
    for name in names:
        spark.conf.unset(name)


def stream(r, size):
    piece = lambda: r.choice([b"\x01", b"\x03", b"\x01\r\r\ntext\x03", b"junk", b"\n", b"\xff\xfe", "é".encode(), b"\x01" + bytes(r.randrange(32, 99) for _ in range(r.randrange(900))) + b"\x03"])
    return b"".join(piece() for _ in range(size))


def test_ranges_equal_the_whole_file(small_ranges, tmp_path):
    r = random.Random(1)
    contents = [stream(r, r.randrange(1, 60)) for _ in range(40)]
    contents += [b"", b"\xef\xbb\xbf", b"\xef\xbb\xbfab\x01x\x03y", b"\xef\xbb\xbf\x01x\x03", b"\x01", b"\x03", b"abc", b"\x01open", b"a\x03b\x01c", b"\x01a\x03" * 500, b"x" * 5000 + b"\x01late\x03" + b"z" * 3000, b"\x01a\x03\x01b"]
    for i, c in enumerate(contents):
        (tmp_path / f"s {i:03}+.sbn").write_bytes(c)
    scanned = {files.plain_path(x.path): x for x in ranges.scan(small_ranges, str(tmp_path)).collect()}
    found: dict = {}
    for x in ranges.frames(small_ranges, str(tmp_path)).collect():
        found.setdefault(files.plain_path(x.path), []).append(x)
    for i, c in enumerate(contents):
        want, name = files.framed(c), f"{tmp_path}/s {i:03}+.sbn"
        if not c:  # Spark lists no empty files
            assert name not in scanned and name not in found
            continue
        x = scanned[name]
        assert (x.frames, x.junk_bytes, x.pending_bytes) == (len(want["chunks"]), want["junk"], want["pending"]), (i, c[:80])
        rows = sorted(found[name], key=lambda y: y.message_index)
        if not want["chunks"]:
            assert [(y.message_index, y.error) for y in rows] == [(1, ranges.NO_FRAMES)] and x.error == ranges.NO_FRAMES
            continue
        assert [(y.message_index, y.byte_start, y.byte_end, bytes(y.raw), y.error) for y in rows] == [(k + 1, w["start"], w["end"], w["bytes"], None) for k, w in enumerate(want["chunks"])]


def test_long_frames_reject_their_file(small_ranges, tmp_path, monkeypatch):
    small_ranges.conf.set("spark.sql.files.maxPartitionBytes", "400000")
    for name, content in {"long": b"\x01" + b"a" * (1 << 20) + b"\x03\x01b\x03", "open": b"\x01b\x03\x01" + b"c" * (1 << 20), "edge": b"\x01b\x03\x01" + b"c" * ((1 << 20) - 1), "full": b"\x01" + b"c" * ((1 << 20) - 2) + b"\x03"}.items():
        (tmp_path / f"{name}.sbn").write_bytes(content)
    got = {x.path.rsplit("/", 1)[1]: x.error for x in ranges.scan(small_ranges, str(tmp_path)).collect()}
    assert got == {"long.sbn": "Oversized", "open.sbn": "Oversized", "edge.sbn": None, "full.sbn": None}


def test_a_stream_is_read_by_many_tasks(small_ranges, tmp_path):
    small_ranges.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    (tmp_path / "one.sbn").write_bytes(b"".join(b"~" * (i % 7) + b"\x01" + f"message {i} ".encode() * 20 + b"\x03" for i in range(20_000)))
    rows = ranges.frames(small_ranges, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20
    got = rows.orderBy("message_index").collect()
    assert [x.message_index for x in got] == list(range(1, 20_001)) and all(x.raw.startswith(b"\x01message %d " % i) for i, x in enumerate(got))


def test_messages_at_take_framed_files_by_range(small_ranges, tmp_path):
    text = "NOUS41 KAAA 201530\nPNSAAA\n\nTEXT\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.SBN").write_bytes(b"junk" + b"".join(b"\x01\r\r\n" + text.replace("\n", "\r\r\n").encode() + b"\x03" for _ in range(30)))
    (tmp_path / "c.sbn").write_bytes(b"nothing")
    whole = files.inspected(files.messages(files.inputs(small_ranges, str(tmp_path))))
    ranged = files.inspected(files.messages_at(small_ranges, str(tmp_path)))
    columns = ["path", "message_index", "input_kind", "transport", "byte_start", "byte_end", "heading", "error_kind", "error_field"]
    assert sorted(ranged.select(columns).collect(), key=str) == sorted(whole.select(columns).collect(), key=str)
    assert ranged.count() == 32
