"""Stanzas of XML streams that arrive in pieces: a replayable source of dropped files, and a splitter that keeps open stanzas.

    spark.readStream.format("stanza_drop")     pieces (stream, number, received_at, bytes) of the files of a folder
    fragments(pieces)                          whole top-level elements, wherever the pieces were cut
    feed(fragments)                            messages for the archive's jobs
    silences(pieces)                           streams that say nothing, interval by interval

A receiver drops files named STREAM-NUMBER.xml; names order the pieces of a stream. What was read is told by the last name of
each stream, so a restart goes on behind it and a failed batch reads the same files again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stanza import stanza

#: An open element longer than this is an error; it is dropped and the stream goes on.
MOST_BYTES = 1 << 24
PIECE = "stream string, number long, received_at timestamp, bytes binary"
_NAME = re.compile(r"(.+)-(\d+)\.[A-Za-z0-9]+\Z")


# --- fragments

_OPENERS = ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>"))
_SPACE = b" \t\n\r\f"


class BadStream(ValueError):
    """Bytes that are no UTF-8 text, or an element that is too long."""


class Splitter:
    """Cuts a byte stream into its top-level elements, piece by piece.

    The state is the bytes of the open element, how far they have been understood, and how many elements are open there; what
    was understood is not read again. The stream's own head is a fragment that never closes.
    """

    def __init__(self, held: bytes = b"", at: int = 0, depth: int = 0) -> None:
        self.held, self.at, self.depth = held, at, depth

    def push(self, piece: bytes) -> list[str]:
        self.held += piece
        out: list[str] = []
        while (end := self._end()) is not None:
            whole = self.held[:end]
            self.held, self.at, self.depth = self.held[end:], 0, 0
            try:
                out.append(whole.decode())
            except UnicodeDecodeError as e:
                raise BadStream("InvalidUtf8") from e
        self._check()
        if len(self.held) > MOST_BYTES:
            self.held, self.at, self.depth = b"", 0, 0
            raise BadStream("Oversized")
        return out

    def _check(self) -> None:
        """The open bytes must be UTF-8, but for a character that the next piece may finish."""
        try:
            self.held.decode()
        except UnicodeDecodeError as e:
            if not (e.reason == "unexpected end of data" and e.end == len(self.held)):
                self.held, self.at, self.depth = b"", 0, 0
                raise BadStream("InvalidUtf8") from e

    def _end(self) -> int | None:
        """Where the first element ends, or None while it is open; comments and instructions before it are dropped."""
        held = self.held
        while True:
            if self.depth == 0:
                while self.at < len(held) and held[self.at] in _SPACE:
                    self.at += 1
                self.held = held = held[self.at :]
                self.at = 0
                if not held:
                    return None
            tag = held.find(b"<", self.at) if self.depth else 0
            if tag < 0:
                self.at = len(held)
                return None
            self.at = tag
            opener = self._opener(held[tag : tag + 9])
            if opener is None:
                return None
            if opener:
                first, last = opener
                if self.depth == 0 and first == b"<![CDATA[":
                    opener = ()
                else:
                    close = held.find(last, tag + len(first))
                    if close < 0:
                        return None
                    self.at = close + len(last)
                    continue
            end = self._tag_end(tag)
            if end is None:
                return None
            own = held[tag:end]
            self.at = end
            if self.depth == 0 and own.startswith(b"<stream:stream"):
                return end
            if own[:-1].rstrip(_SPACE).endswith(b"/") and not own.startswith(b"</"):
                if self.depth == 0:
                    return end
            elif own.startswith(b"</"):
                self.depth -= 1
                if self.depth <= 0:
                    return end
            else:
                self.depth += 1

    @staticmethod
    def _opener(head: bytes) -> tuple | None:
        """The comment, section or instruction that begins; () for a tag, None if more bytes must tell."""
        for first, last in _OPENERS:
            if head.startswith(first):
                return first, last
            if first.startswith(head):
                return None
        return ()

    def _tag_end(self, tag: int) -> int | None:
        quote = 0
        for i in range(tag + 1, len(self.held)):
            c = self.held[i]
            if quote:
                quote = 0 if c == quote else quote
            elif c in b"'\"":
                quote = c
            elif c == 0x3E:
                return i + 1
        return None


_FRAGMENT = "stream string, number long, received_at timestamp, fragment string, error string"


def fragments(pieces: DataFrame) -> DataFrame:
    """Top-level elements of a streaming DataFrame of pieces, numbered from 1 in each stream, with the arrival of the piece that
    ended them. Bytes that are no UTF-8, or an element beyond MOST_BYTES, are a row with an error, and the stream goes on."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at, depth, number = state.get if state.exists else (b"", 0, 0, 0)
        splitter, out = Splitter(bytes(held), at, depth), []
        rows = pd.concat(list(batches)).sort_values("number", kind="stable")
        for piece, came in zip(rows["bytes"], rows["received_at"], strict=True):
            try:
                found = [(f, None) for f in splitter.push(bytes(piece or b""))]
            except BadStream as e:
                found = [(None, str(e))]
            for fragment, error in found:
                number += 1
                out.append((key[0], number, came, fragment, error))
        state.update((splitter.held, splitter.at, splitter.depth, number))
        yield pd.DataFrame(out, columns=["stream", "number", "received_at", "fragment", "error"])

    return pieces.select("stream", "number", "received_at", "bytes").groupBy("stream").applyInPandasWithState(run, _FRAGMENT, "held binary, at long, depth long, number long", "append", GroupStateTimeout.NoTimeout)


def feed(found: DataFrame) -> DataFrame:
    """Messages of fragments: path (the stream), message_index, raw, received_at and the wrapper's id and issue time. Other
    elements, stanzas without a bulletin and broken ones are skipped, as a client does."""
    named = found.where(F.col("fragment").rlike(r"^<(?:[^\s/>]*:)?message[\s/>]"))
    read = named.withColumn("s", stanza(F.col("fragment"))).where(F.col("s.error").isNull() & F.col("s.payload").isNotNull())
    return read.select(F.col("stream").alias("path"), F.col("number").cast("int").alias("message_index"), F.col("s.payload.raw").alias("raw"), "received_at", F.col("s.payload.id").alias("wrapper_id"), F.col("s.payload.issue").alias("wrapper_issue"))


# --- the source


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.history = int(options.get("history", -1))

    def _files(self) -> dict[str, list[tuple[int, str]]]:
        from pyarrow import fs

        out: dict[str, list[tuple[int, str]]] = {}
        for info in self.store.get_file_info(fs.FileSelector(self.root, recursive=False, allow_not_found=True)):
            if info.is_file and (m := _NAME.match(info.base_name)):
                out.setdefault(m[1], []).append((int(m[2]), info.path))
        return {k: sorted(v) for k, v in out.items()}

    def initialOffset(self) -> dict:
        """All files are new, or the last `history` of each stream."""
        if self.history < 0:
            return {"read": "{}"}
        return {"read": json.dumps({k: v[-self.history - 1][0] if len(v) > self.history else -1 for k, v in self._files().items()})}

    def latestOffset(self) -> dict:
        return {"read": json.dumps({k: v[-1][0] for k, v in sorted(self._files().items())})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = json.loads(start["read"]), json.loads(end["read"])
        return [_File(path) for stream, files in self._files().items() for number, path in files if low.get(stream, -1) < number <= high.get(stream, -1)]

    def read(self, partition: _File) -> Iterator[tuple]:
        m = _NAME.match(partition.path.rsplit("/", 1)[1])
        info = self.store.get_file_info(partition.path)
        with self.store.open_input_stream(partition.path) as f:
            yield (m[1], int(m[2]), info.mtime or datetime.now(UTC), f.read())

    def commit(self, end: dict) -> None:
        pass

    def __getstate__(self) -> dict:
        return {"store": self.store, "root": self.root, "history": self.history}


class StanzaDrop(DataSource):
    """Files STREAM-NUMBER.EXT of a folder as pieces of byte streams. Options: path, on any store that Arrow opens; history, how
    many of the files that are there at the first start belong to each stream's feed (all, unless told)."""

    @classmethod
    def name(cls) -> str:
        return "stanza_drop"

    def schema(self) -> str:
        return PIECE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


# --- silence

_SILENCE = "stream string, silent_intervals int, rebuild boolean"


def silences(pieces: DataFrame, seconds: float = 30.0, most: int = 10) -> DataFrame:
    """A row for each interval in which a stream said nothing, counted from its last piece; with the `most`th in a row rebuild is
    true and the count begins anew, as a client closes and connects again then. Works on the clock, by a timer for each stream."""
    wait = int(seconds * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, out = 0, []
        if state.hasTimedOut:
            count = state.get[0] + 1
            out.append((key[0], count, count >= most))
            count = count % most
        else:
            for _ in batches:
                pass
        state.update((count,))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["stream", "silent_intervals", "rebuild"])

    return pieces.select("stream").groupBy("stream").applyInPandasWithState(run, _SILENCE, "silent int", "append", GroupStateTimeout.ProcessingTimeTimeout)
