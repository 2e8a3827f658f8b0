"""What reports move, write and parse is what they need: rows once, texts once, no field that nobody reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wxlake.functions import hashing, segmenter
from wxlake.operators import archive, reports, summaries
from wxlake.plans import more_queries, render
from wxlake.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_counted_without_python(spark):
    r = random.Random(4)
    contents = [None, b"", b"\x03", b"\x01", b"a\x03b\x01c", b"\x01\x01a\x03\x03b\x03", b"\xff\x01\xfe\x03\xc3\x01x\x03zz"]
    contents += [bytes(r.choice(b"\x01\x03ab\xff\x80\x0a") for _ in range(r.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(str(i), None if c is None else bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    found = files.split_frames(rows)
    assert "Python" not in _plan(found) and "Pandas" not in _plan(found)
    got = {row.path: (row.frames, row.junk_bytes, row.pending_bytes) for row in found.collect()}
    for i, c in enumerate(contents):
        want = files.framed(c)
        assert got[str(i)] == (len(want["chunks"]), want["junk"], want["pending"]), c


def test_first_messages_move_once(spark, monkeypatch):
    monkeypatch.setattr(archive, "settled", None)  # nothing is written on the way
    rows = spark.range(3000).select(F.pmod("id", F.lit(7)).cast("string").alias("semantic_fingerprint"), F.concat(F.lit("p/"), F.lpad((F.col("id") % 1000).cast("string"), 4, "0")).alias("path"), F.lit(1).alias("message_index"))
    first = archive.first_of_each(rows)
    assert _plan(first).count("Exchange hashpartitioning") == 1
    assert sorted((r.semantic_fingerprint, r.path) for r in first.collect()) == [(str(i), min(f"p/{j % 1000:04}" for j in range(3000) if j % 7 == i)) for i in range(7)]


def test_verification_finds_each_status_once(spark):
    same = F.udf(lambda x: x)
    status = spark.createDataFrame([("ok", "tornado"), ("ok", "tornado"), ("ok", None), ("error", "tornado")], "status string, family string")
    counts = summaries.verify_counts(status.withColumn("status", same("status")))
    assert _plan(counts).count("BatchEvalPython") == 1
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([("verified_records", None, 3), ("failures", None, 1), ("families", "tornado", 2), ("families", None, 1)], key=str)
    assert sorted(map(tuple, summaries.verify_counts(status.limit(0)).collect())) == [("failures", None, 0), ("verified_records", None, 0)]


def test_fields_that_nobody_reads_change_no_error(spark):
    """The parser that leaves out codes says the same of errors, headers and families as the whole one, also of segments behind codes."""
    body = "ILC031-211630-\n/O.NEW.KAAA.TO.W.0001.240101T0000Z-240101T0100Z/\n\n{}\n$$\n"
    lines = ["LAT...LON 3000 8000", "LAT...LON 3000 8000 31", "LAT...LON 9900 8000", "TIME...MOT...LOC 1200Z 400DEG 5KT 3000 8000", "TIME...MOT...LOC 1200Z 300DEG 5KT 3000 8000", "TEXT", ""]
    texts = [f"WUUS53 KAAA 201530\n{name}\nSOME TITLE\n" + body.format(x) for x in lines for name in ("TORAAA\n", "")] + [None, "", "NOUS41 KAAA 201530\nPNSAAA\n\nTEXT\n"]
    rows = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "path string, message_index int, raw string")
    told = ("path", "error_kind", "error_field", "mnd_header", "family")
    whole = reports.parsed(rows).select(*told, F.size("parts").alias("n")).collect()
    slim = reports.parsed(rows, told[1:4], ("dollars",)).select(*told, F.size("parts").alias("n")).collect()
    assert sorted(map(tuple, slim)) == sorted(map(tuple, whole)) and {r.error_kind for r in whole} >= {None, "InvalidField"}
    read = segmenter.parse(texts[1], frozenset(("dollars",)))["first_code"]
    assert read is not None and "pvtec" not in segmenter.parse(texts[0], frozenset(("dollars",)))["parts"][0]


def test_imports_and_feeds_carry_texts_once(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    assert not {"raw", "bulletin", "body"} & set(more_queries._digested(spark, str(tmp_path)).columns)
    # A message is dealt over the tasks before it is a text.
    plan = _plan(render.messages(spark, str(tmp_path)))
    assert "WUUS53" in plan[: plan.index("Exchange")] and "WUUS53" not in plan[plan.index("Exchange") :]
    monkeypatch.setattr(more_queries, "settled", None)  # the feed is not written before its own files are
    feed = more_queries._redelivered(spark, str(tmp_path))
    assert sorted((r.batch, r["count"]) for r in feed.groupBy("batch").count().collect()) == [(0, 40), (1, 20), (2, 40)]


def test_outlines_say_what_whole_segments_say():
    """Texts whose decisive lines alone are looked at have the same error, title and segments."""
    r = random.Random(11)
    lines = ["ILC031-211630-", "ILC031-033-", "211630-", "ILC001>003-211630-", "  TXZ001>002-211630-\r", "$$", " $$ \t", "$$ x", "LAT...LON 3000 8000 3010 8000", " LAT...LON 3000 8000", "     3010 8010 3020 8020", "3000 \r 8000", "LAT...LON 9900 8000", "LAT...LON 3000 18101", "LAT...LON", "TIME...MOT...LOC 1200Z 300DEG 5KT 3000 8000", "TIME...MOT...LOC 1200Z 400DEG 05KT 3000 8000", "x LAT...LON", "TEXT", "", "\f", "\x1cILC031-211630-"]
    errors = set()
    for _ in range(5000):
        body = "".join(r.choice(lines) + r.choice(["\n", "\r\n", "\r\r\n"]) for _ in range(r.randrange(14)))
        told = []
        for read in (segmenter.outlined, lambda b: segmenter.segments(b, frozenset(("dollars",)), False)):
            try:
                header, found = read(body)
                told.append((header, [s["dollars"] for s in found]))
            except segmenter.Malformed as e:
                told.append(str(e))
        assert told[0] == told[1], body
        errors.add(told[0] if isinstance(told[0], str) else None)
    assert errors == {None, "LAT...LON", "TIME...MOT...LOC"}


def test_digests_come_with_the_parsed_fields(spark):
    texts = [None, "", "WUUS53 KAAA 201530\nTORAAA\n\nTEXT\n", "123\r\nWUUS53 KAAA 201530\r\nTÖRAAA\r\n", "\x01\r\r\nWUUS53 KAAA 201530\r\r\nTEXT\r\r\n\x03", "x" * 5000 + "\n"]
    rows = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "path string, message_index int, raw string")
    known = reports.parsed(rows, (*archive.IMPORTED, "raw_digest"), archive.COUNTED)
    assert _plan(archive.digested(known)).count("ArrowEvalPython") == 1
    whole = reports.parsed(rows).select("path", hashing.fnv1a(F.col("bulletin")), F.sha2("bulletin", 256), hashing.fnv1a(F.col("raw")))
    assert sorted(map(tuple, known.select("path", "digest", "text_digest", "raw_digest").collect())) == sorted(map(tuple, whole.collect()))


def test_imported_rows_meet_their_texts_choice_in_one_join(spark):
    rows = spark.createDataFrame([(f"p/{i % 7}", 1, "f", f"{i % 3:016x}", f"{i % 5}") for i in range(60)], "path string, message_index int, folder string, digest string, text_digest string")
    done = archive.imported(rows)
    assert _plan(done).count("Join") == 1
    got = done.collect()
    assert len(got) == 60 and len({r.relative_path for r in got}) == 15 == sum(r.action == "archived" for r in got)


def test_no_pattern_is_searched_for_in_each_rows_path(spark, tmp_path):
    path = f"{tmp_path}/archive"
    for i in range(3):
        spark.range(3).select("id", F.lit("2024-01-20").alias("capture_date"), F.lit("flood").alias("family")).coalesce(1).write.mode("append").partitionBy("capture_date", "family").parquet(path)
    assert archive.compact(spark, path, "2024-01-20") == 3
    left = archive.current(spark, path)
    assert sorted(r.id for r in left.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and "[^/]+" not in _plan(left)


def test_an_import_reads_written_rows_where_they_are(spark, monkeypatch):
    """Rows that were written with numbers are not written again; the archive's texts are met within the same aggregate."""
    rows = [(f"p/{i:02}", 1, "f", f"{i % 3:016x}", f"{i % 6}") for i in range(24)]
    known = archive.numbered(spark.createDataFrame(rows, "path string, message_index int, folder string, digest string, text_digest string"))
    # Of digest 0 the archive has text 3, of digest 1 a text that does not come again; another folder does not count.
    index = spark.createDataFrame([("f", f"{0:016x}", "3", 0), ("f", f"{1:016x}", "x", 4), ("g", f"{2:016x}", "2", 7)], "folder string, digest string, text_digest string, number int")
    monkeypatch.setattr(archive, "settled", None)
    done = archive.imported(known, index)
    assert _plan(done).count("Join") == 1
    got = {r.path: (r.action, r.relative_path) for r in done.collect()}
    assert len(got) == 24 and "_row" not in done.columns
    new = {f"p/{i:02}": n for i, n in ((0, "0000-1"), (1, "0001-5"), (4, "0001-6"), (2, "0002"), (5, "0002-1"))}
    assert {p: r.removeprefix("f/").removesuffix(".txt")[12:] for p, (a, r) in got.items() if a == "archived"} == new
    assert {r for p, (_, r) in got.items() if int(p[2:]) % 6 == 3} == {f"f/{0:016x}.txt"}


def test_records_are_verified_in_one_pass_behind_their_import(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    status = more_queries.verified(spark, str(tmp_path))
    plan = _plan(status)
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 1  # the import's own join, and no other for the names
    got = {r.path: r.status for r in status.collect()}
    assert got["src/000000017.txt"] == got["src/000000034.txt"] == "error" and list(got.values()).count("error") == sum(int(p[4:13]) % 17 == 0 for p in got)


def test_every_day_is_compacted_each_time(spark, tmp_path, monkeypatch):
    """Six days from the 15th on and two before it: no day is left out of a compaction, and one job rewrites them all."""
    at = F.timestamp_seconds(F.lit(1_705_104_000) + F.col("id") * 1800)  # 2024-01-13, 48 a day
    spark.range(8 * 48).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    told, compact = [], archive.compact
    monkeypatch.setattr(more_queries, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(archive, "compact", lambda spark, path, days: told.append((sorted([days] if isinstance(days, str) else days), compact(spark, path, days))))
    more_queries.compacted_archive(spark, str(tmp_path)).collect()
    days = [f"2024-01-{d}" for d in range(15, 21)]
    assert [d for d, _ in told] == [days, days] and all(n >= 2 * len(days) for _, n in told)
    for day in days:
        assert {f.name[:10] for f in (tmp_path / "archive" / f"capture_date={day}").rglob("*.parquet")} == {"compacted-"}
    assert compact(spark, f"{tmp_path}/archive", days[:2], least=99) == 0
