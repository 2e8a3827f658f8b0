"""Stanza streams: fragments whatever the cuts, the dropped-file source across restarts, silence."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from wxlake.session import shared_dir
from wxlake.streaming import jobs, stanzas
from wxlake.streaming.stanzas import BadStream, Splitter

HEAD = "<?xml version='1.0'?><stream:stream to='h' xmlns:stream='s'>"
WHOLE = [
    HEAD.split("?>")[1],
    "<presence/>",
    "<message a='<>\"'><body>x &lt; y</body><!-- </message> --><x><![CDATA[</message>]]></x></message>",
    "<iq type=\"result\"  / >".replace(" / >", " />"),
    "<message><?pi </message>?>é日本<b/><c></c></message>",
    "<a:message><a:b><a:b></a:b></a:b></a:message>",
]


def test_cuts_anywhere_change_nothing():
    raw = (HEAD + "\n <!-- between <x> -->" + " ".join(WHOLE[1:]) + "\n").encode()
    for cut in range(len(raw) + 1):
        s = Splitter()
        assert s.push(raw[:cut]) + s.push(raw[cut:]) == WHOLE
    s = Splitter()
    assert [f for b in raw for f in s.push(bytes([b]))] == WHOLE and s.held == b""
    r = random.Random(1)
    for _ in range(50):
        s, out, at = Splitter(), [], 0
        while at < len(raw):
            n = r.randrange(1, 40)
            out += s.push(raw[at : at + n])
            at += n
            s = Splitter(s.held, s.at, s.depth)
        assert out == WHOLE


def test_bad_streams_go_on(monkeypatch):
    s = Splitter()
    assert s.push("<a>é".encode()[:-1]) == []
    with pytest.raises(BadStream, match="InvalidUtf8"):
        s.push(b"\xff")
    assert s.push(b"<b/>") == ["<b/>"]
    monkeypatch.setattr(stanzas, "MOST_BYTES", 10)
    with pytest.raises(BadStream, match="Oversized"):
        s.push(b"<a>" + b"x" * 20)
    assert s.push(b"<c/>") == ["<c/>"]


BULLETIN = "NOUS41 KAAA 201530\nPNSAAA\n\nTEXT {}\n"


def message(i):
    return f"<message type='groupchat'><body>b</body><x xmlns='nwws-oi' cccc='KAAA' ttaaii='NOUS41' issue='2024-01-20T15:30:00Z' awipsid='PNSAAA' id='7.{i}'>{BULLETIN.format(i)}</x></message>"


def test_the_source_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(stanzas.StanzaDrop)
    drop = tmp_path / "drop"
    drop.mkdir()
    raw = (HEAD + "".join(message(i) + "<presence/>" + "<message><body>no bulletin</body></message>" for i in range(9))).encode()
    cuts = [0, 500, 501, 1700, 1701, 2600, len(raw)]
    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def run(history=None):
        reader = spark.readStream.format("stanza_drop").option("path", str(drop))
        pieces = (reader if history is None else reader.option("history", history)).load()
        rows = stanzas.feed(stanzas.fragments(pieces))
        out, check = (str(tmp_path / f"{name}{history}") for name in ("out", "check"))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    for i, part in enumerate(parts[:3]):
        (drop / f"k-{i:05}.xml").write_bytes(part)
    (drop / "notes.txt").write_text("no piece")
    first = run().count()
    for i, part in enumerate(parts[3:]):
        (drop / f"k-{i + 3:05}.xml").write_bytes(part)
    (drop / "other-1.xml").write_bytes(message(77).encode())
    got = run()
    assert first < 9 and sorted(x.wrapper_id for x in got.collect()) == sorted([*(f"7.{i}" for i in range(9)), "7.77"])
    assert run().count() == 10  # nothing new
    assert [x.raw for x in got.where("wrapper_id = '7.3'").collect()] == [BULLETIN.format(3).strip("\n")]
    (drop / "k-00006.xml").write_bytes(message(9).encode())
    late = run(history=1)  # starts with the newest piece of each stream that was there
    assert sorted(x.wrapper_id for x in late.collect()) == ["7.77", "7.9"]


def test_silence_is_told(spark, tmp_path):
    spark.dataSource.register(stanzas.StanzaDrop)
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "k-1.xml").write_bytes(b"<a/>")
    pieces = spark.readStream.format("stanza_drop").option("path", str(tmp_path / "drop")).load()
    found: list = []
    query = stanzas.silences(pieces, 0.5, 3).writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and len(found) < 5:
        time.sleep(0.3)
    query.stop()
    assert [(x.silent_intervals, x.rebuild) for x in found[:5]] == [(1, False), (2, False), (3, True), (1, False), (2, False)]


# --- archiving


def _messages(spark, rows):
    kind = "path string, message_index int, raw string, received_at timestamp"
    return spark.createDataFrame([(p, 1, BULLETIN.format(t), at) for p, t, at in rows], kind)


def test_repeated_rows_and_batches_are_archived_once(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 1, 20, 12)
    batch = _messages(spark, [("a", 1, at), ("a", 1, at), ("b", 1, at), ("c", 2, at)])
    count = lambda path: spark.read.parquet(path).count()
    tables = lambda: {x for x in spark._jvm.java.io.File(shared_dir(spark).removeprefix("file:") + "/wxlake").list() or [] if x.startswith(("keyed", "batch"))}
    before = tables()
    once, every, state = (str(tmp_path / n) for n in ("once", "every", "state"))
    sink = jobs.archiving(once, "feed")
    assert sink(batch, 0)["archived"] == 2 and sink(batch, 0)["archived"] == 0 and count(once) == 2
    keep = jobs.lasting(jobs.archiving(every, "feed", duplicates=True), state, "all")
    for number in (0, 0, 1):  # a batch that is repeated, then the same rows as a new one
        keep(batch, number)
    assert count(every) == 8
    told = jobs.status(spark, state).first()
    assert (told.batches, told.received, told.parsed, told.rejected) == (2, 8, 8, 0)
    assert tables() == before  # what a batch needed for itself is gone


def test_fingerprints_expire(spark, tmp_path):
    """Within the time a copy goes, whatever the restarts; beyond it the text is new again. Batches stay as quick as at first."""
    from datetime import datetime, timedelta

    feed, check, out, took = str(tmp_path / "feed"), str(tmp_path / "check"), str(tmp_path / "out"), []
    first = datetime(2024, 1, 20, 12)
    arrivals = [(0, "x"), (30, "x"), (59, "y"), (61, "y"), (200, "z"), (205, "x"), (206, "x"), (400, "w"), (401, "y"), *((500 + i, f"n{i}") for i in range(12))]
    for i, (minutes, text) in enumerate(arrivals):
        _messages(spark, [(f"p{i}", text, first + timedelta(minutes=minutes))]).write.mode("append").parquet(feed)
        started = time.time()
        rows = jobs.recognised(spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed), "1 hour")
        jobs.captured(jobs.started(rows, jobs.archiving(out, "feed"), check))
        took.append(time.time() - started)
    got = sorted(x.source_path for x in spark.read.parquet(out).collect())
    want = ["p0", "p2", "p4", "p5", "p7", "p8", *(f"p{9 + i}" for i in range(12))]
    assert set(got) <= {f"p{i}" for i in range(len(arrivals))} and "p1" not in got and "p3" not in got and "p6" not in got
    # The archive's own day still holds texts of that day: what a repeated batch must not write again.
    assert got == sorted(set(want) - {"p5", "p8"})
    assert sum(took[-4:]) < 3 * sum(took[:4])


def test_recognised_messages_move_what_the_archive_keeps(spark, tmp_path, monkeypatch):
    """One text a row and no parsed segment but their separators goes to the state, and the first batch is not written before its archive."""
    from datetime import datetime

    from wxlake.operators import archive

    feed, out, written = str(tmp_path / "feed"), str(tmp_path / "out"), []
    _messages(spark, [(f"p{i}", i % 3, datetime(2024, 1, 20, 12)) for i in range(6)]).write.parquet(feed)
    rows = jobs.recognised(spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed), "1 hour")
    assert not {"raw", "body"} & set(rows.columns) and "bulletin" in rows.columns
    assert [f.name for f in rows.schema["parts"].dataType.elementType] == list(archive.COUNTED)
    settled = jobs.settled
    monkeypatch.setattr(jobs, "settled", lambda df, name: written.append(name) or settled(df, name))
    jobs.captured(jobs.started(rows, jobs.archiving(out, "feed"), str(tmp_path / "check")))
    assert spark.read.parquet(out).count() == 3 and len(written) <= 1  # that of the empty batch behind it, which moves the watermark
