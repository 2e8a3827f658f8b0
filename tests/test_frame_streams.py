"""Framed streams in pieces, however many there are."""

from __future__ import annotations

import random

from wxlake.streaming import frames


def _run(spark, tmp_path, batches, **how):
    """What the batches of pieces (stream, number, bytes) give, and the rows of state that are kept behind the last one."""
    feed, out, check, last = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "check"), None
    for rows in batches:
        spark.createDataFrame([(s, n, b if b is None else bytearray(b)) for s, n, b in rows], "stream string, number int, bytes binary").write.mode("append").parquet(feed)
        read = spark.readStream.schema("stream string, number int, bytes binary").parquet(feed)
        query = frames.reassembled(read, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        last = query.lastProgress
    return spark.read.parquet(out).collect(), sum(s["numRowsTotal"] for s in last["stateOperators"])


def test_streams_share_calls_and_keep_their_own_state(spark, tmp_path):
    r = random.Random(3)
    names = [None, "", *(f"s{i}" for i in range(200))]
    batches, want = [], {}
    for k in range(3):
        rows = []
        for name in names if k < 2 else names[::2]:
            pieces = [bytes(r.choice(b"\x01\x03ab~") for _ in range(r.randrange(12))) for _ in range(2)]
            rows += [(name, 2 * k + i, p) for i, p in enumerate(pieces)]
            told, *state = want.get(name, ([], b"", 0, 0))
            for p in pieces:
                found, *state = frames.push(*state, p)
                told += found
            want[name] = (told, *state)
        r.shuffle(rows)
        batches.append(rows)
    got, kept = _run(spark, tmp_path, batches, groups=4)
    assert kept == 4
    for name in names:
        own = [x for x in got if x.stream == name]
        assert sorted((x.frame_offset, x.leading_junk, bytes(x.raw)) for x in own if x.raw is not None) == sorted(want[name][0])
        told = sorted((x.frame_offset, x.discarded_junk, x.pending_bytes) for x in own if x.pending_bytes is not None)
        assert len(told) == (3 if name in names[::2] else 2)
        assert told[-1] == (want[name][2], want[name][3], len(want[name][1]))


def test_an_oversized_frame_is_its_own_streams_error(spark, tmp_path):
    batches = [[("a", 0, b"\x01" + b"x" * 20), ("b", 0, b"\x01yz")], [("a", 1, b"x\x03\x01q\x03"), ("b", 1, b"\x03"), ("c", 1, None)]]
    got, _ = _run(spark, tmp_path, batches, most=10, groups=1)
    assert [(x.stream, x.error) for x in got if x.error] == [("a", "Oversized")]
    assert sorted((x.stream, x.frame_offset, bytes(x.raw)) for x in got if x.raw is not None) == [("a", 23, b"\x01q\x03"), ("b", 0, b"\x01yz\x03")]
    assert [(x.frame_offset, x.discarded_junk, x.pending_bytes) for x in got if x.stream == "c"] == [(0, 0, 0)]
