"""Framed byte streams of any size, read in byte ranges.

    scan(spark, path)    per file: frames, junk, pending bytes and the error that rejects it
    frames(spark, path)  one row a frame with its offsets, or one row with the error of its file

The text reader takes the end byte of a frame as its line separator: every task reads the records that begin in its range of a
file, wherever ranges are cut, and a frame belongs to the range in which its record begins. Records cover a file without
gaps, so the offset of a range's first record is the sum of the records before it. The first pass leaves one slim
row a range; running sums over a file's ranges give offsets, frame numbers and file totals. The second pass reads the ranges
again and adds the offsets, so no byte of a frame is shuffled. A junk run between frames needs no range of its own: it is
part of the record that it precedes.

The reader drops a byte-order mark at the head of a file and says nothing of whether the last record was ended; both follow
from the difference between the file's length and the sum of its records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled

END = "\x03"
START = 1
#: Frames longer than this are an error, and so is an open frame.
MOST_FRAME_BYTES = 1 << 20
# The errors of a file.
OVERSIZED, NO_FRAMES = "Oversized", "no framed messages detected in stream"
#: A table of ranges of at most this many rows is broadcast; 100 TB in ranges of 128 MB are 800,000.
MOST_RANGES = 1_000_000

RANGE = "path string, size long, at long, bytes long, frames int, first_start long, last_end long, longest long, last_start long, last_size long"
FRAME = "path string, at long, place int, start long, end long, raw binary"


def records(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Raw records of the files below a path, each up to an end byte, with the file, its length and the range's beginning.
    Files that `wanted`, a condition on _metadata, does not hold for are not read."""
    rows = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path)
    if wanted is not None:
        rows = rows.where(wanted)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))


def _starts(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of binary values: their offsets in their common bytes, the place of the first start byte in each (-1: none), the bytes."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    hits = np.flatnonzero(raw == START)
    at = np.searchsorted(hits, offsets[:-1])
    found = hits[np.minimum(at, max(0, len(hits) - 1))] if len(hits) else np.zeros(len(values), np.int64)
    inside = (at < len(hits)) & (found < offsets[1:]) if len(hits) else np.zeros(len(values), bool)
    return offsets, np.where(inside, found - offsets[:-1], -1), raw


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Neighbouring rows of one file and range."""
    same = np.ones(len(batch), bool)
    paths, at = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
    same[1:] = (paths[1:] == paths[:-1]) & (at[1:] == at[:-1])
    edges = [0, *np.flatnonzero(~same).tolist(), len(batch)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


class _Summary:
    """A range's records, summed up but for the last one, which may lack its end byte. Offsets count from the first record."""

    def __init__(self, path: str, size: int, at: int) -> None:
        self.key, self.size, self.bytes, self.frames, self.longest = (path, at), size, 0, 0, 0
        self.first: int | None = None
        self.end: int | None = None
        self.last: tuple[int, int] | None = None  # place of the start byte in the last record, its length

    def add(self, size: np.ndarray, start: np.ndarray) -> None:
        if self.last is not None:
            start, size = np.concatenate([[self.last[0]], start]), np.concatenate([[self.last[1]], size])
        begin = self.bytes + np.cumsum(size + 1) - size - 1
        framed = np.flatnonzero(start[:-1] >= 0)
        if len(framed):
            self.first = int(begin[framed[0]] + start[framed[0]]) if self.first is None else self.first
            self.end = int(begin[framed[-1]] + size[framed[-1]] + 1)
            self.longest = max(self.longest, int((size[framed] - start[framed]).max()) + 1)
            self.frames += len(framed)
        self.bytes += int((size[:-1] + 1).sum())
        self.last = (int(start[-1]), int(size[-1]))

    def row(self) -> tuple:
        start, size = self.last
        there = start >= 0
        first = self.bytes + start if self.first is None and there else self.first
        return (self.key[0], self.size, self.key[1], self.bytes + size + 1, self.frames + there, first, self.end, self.longest, start if there else None, size)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of RANGE for each range."""
    names = [f.split()[0] for f in RANGE.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 5]
    held: _Summary | None = None

    def row(h: _Summary) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(h.row(), kinds, strict=True)], names=names)

    for batch in batches:
        if not len(batch):
            continue
        offsets, start, _ = _starts(batch.column(3))
        size = np.diff(offsets)
        for lo, hi in _runs(batch):
            key = (batch.column(0)[lo].as_py(), batch.column(2)[lo].as_py())
            if held is None or held.key != key:
                if held is not None:
                    yield row(held)
                held = _Summary(key[0], batch.column(1)[lo].as_py(), key[1])
            held.add(size[lo:hi], start[lo:hi])
    if held is not None:
        yield row(held)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of records with their range, number and offsets within it."""
    key, done, number = None, 0, 0
    for batch in batches:
        if not len(batch):
            continue
        offsets, start, raw = _starts(batch.column(3))
        size = np.diff(offsets)
        out = []
        for lo, hi in _runs(batch):
            now = (batch.column(0)[lo].as_py(), batch.column(2)[lo].as_py())
            if now != key:
                key, done, number = now, 0, 0
            own = size[lo:hi]
            begin = done + np.cumsum(own + 1) - own - 1
            for i in np.flatnonzero(start[lo:hi] >= 0):
                number += 1
                s = int(start[lo + i])
                out.append((*key, number, int(begin[i]) + s, int(begin[i] + own[i]) + 1, raw[offsets[lo + i] + s : offsets[lo + i + 1]].tobytes() + END.encode()))
            done += int((own + 1).sum())
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["path", "at", "place", "start", "end", "raw"])


def ranges(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """One row a range: where its first record begins in the file, the frames before it, and the file's totals."""
    found = settled(records(spark, path, wanted).mapInArrow(_summarised, RANGE), "ranges")
    file, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumns({"spare": F.col("size") - F.sum("bytes").over(file), "is_last": F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"))) == 1})
    mark = F.when(F.col("spare") >= 2, 3).otherwise(0)
    is_open = F.col("is_last") & F.col("spare").isin(-1, 2)  # the file's last record was not ended
    rows = rows.withColumns({"base": mark + F.coalesce(F.sum("bytes").over(before), F.lit(0)), "number": F.coalesce(F.sum("frames").over(before), F.lit(0)), "is_open": is_open})
    cut = F.col("is_open") & F.col("last_start").isNotNull()
    ended = F.when(F.col("last_start").isNotNull() & ~F.col("is_open"), F.col("base") + F.col("bytes"))
    own = F.when(F.col("last_start").isNotNull() & ~F.col("is_open"), F.col("last_size") - F.col("last_start") + 1)
    rows = rows.withColumns(
        {
            "total": F.sum(F.col("frames") - cut.cast("int")).over(file),
            "junk": F.coalesce(F.min(F.col("base") + F.col("first_start")).over(file), F.col("size")),
            "end": F.max(F.greatest(F.col("base") + F.col("last_end"), ended)).over(file),
            "most": F.max(F.greatest("longest", own)).over(file),
        }
    )
    rows = rows.withColumn("pending", F.col("size") - F.coalesce("end", "junk"))
    over = (F.col("most") > MOST_FRAME_BYTES) | (F.col("pending") > MOST_FRAME_BYTES)
    return rows.select("path", "at", "base", "number", "size", F.col("total").cast("int").alias("total"), "junk", "pending", F.when(over, OVERSIZED).when(F.col("total") == 0, NO_FRAMES).alias("error"))


def scan(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """One row a file: frames, junk before the first, bytes behind the last, and the error that rejects it. Spark lists no
    empty files."""
    return _files(spark, path, wanted, ranges(spark, path, wanted))


def _files(spark: SparkSession, path: str, wanted: Column | None, known: DataFrame) -> DataFrame:
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    every = (every if wanted is None else every.where(wanted)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    totals = known.groupBy("path").agg(*(F.first(c).alias(c) for c in ("total", "junk", "pending", "error")))
    none = F.col("total").isNull()  # a file without any record
    return every.join(totals, "path", "left").select("path", F.coalesce("total", F.lit(0)).alias("frames"), F.coalesce("junk", "length").alias("junk_bytes"), F.coalesce("pending", F.lit(0)).cast("long").alias("pending_bytes"), F.when(none, NO_FRAMES).otherwise(F.col("error")).alias("error"))


def frames(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """path, message_index, byte_start, byte_end, raw bytes and error: a row for each frame, or one for a file with an error."""
    known = settled(ranges(spark, path, wanted), "ranges")
    few = known.count() <= MOST_RANGES
    places = known.where("error is null").select("path", "at", "base", "number", "total")
    rows = records(spark, path, wanted).mapInArrow(_read, FRAME).join(F.broadcast(places) if few else places, ["path", "at"])
    rows = rows.withColumn("message_index", (F.col("number") + F.col("place")).cast("int")).where(F.col("message_index") <= F.col("total"))
    good = rows.select("path", "message_index", (F.col("base") + F.col("start")).alias("byte_start"), (F.col("base") + F.col("end")).alias("byte_end"), "raw", F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = _files(spark, path, wanted, known).where("error is not null").select("path", F.lit(1).alias("message_index"), none("long").alias("byte_start"), none("long").alias("byte_end"), none("binary").alias("raw"), "error")
    return good.unionByName(bad)
