"""Frames of byte streams that arrive in pieces: a frame may begin in one micro-batch and end in a later one.

Each stream keeps the bytes of its open frame, how many bytes it has consumed and how many of them were junk. Pieces carry
a number; within a micro-batch they are put in its order. What a stream keeps is bounded by the longest frame that is allowed. Streams
are dealt over a fixed number of groups that keep their state in common: a Python call a stream and micro-batch costs milliseconds
whatever its bytes, and there may be millions of streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import MOST_FRAME_BYTES

_OUT = "stream string, frame_offset long, leading_junk long, raw binary, discarded_junk long, pending_bytes long, error string"
_STATE = "streams array<struct<stream string, buffer binary, consumed long, discarded long>>"
#: Groups that streams are dealt over: of two million streams one has some 490, each with its open frame.
GROUPS = 1 << 12


def push(buffer: bytes, consumed: int, discarded: int, piece: bytes) -> tuple[list[tuple[int, int, bytes]], bytes, int, int]:
    """Frames (offset, junk before, bytes) that a piece completes, and the new state. All junk counts as discarded."""
    data, frames, at = buffer + piece, [], 0
    while (start := data.find(b"\x01", at)) >= 0 and (end := data.find(b"\x03", start)) >= 0:
        frames.append((consumed + start, start - at, data[start : end + 1]))
        discarded += start - at
        at = end + 1
    open_at = start if start >= 0 else len(data)
    return frames, data[open_at:], consumed + open_at, discarded + open_at - at


def reassembled(pieces: DataFrame, most: int = MOST_FRAME_BYTES, groups: int = GROUPS) -> DataFrame:
    """Frames of a streaming DataFrame of pieces (stream, number, bytes).

    Besides frames, each stream has a row without bytes for each micro-batch that it is in: how far it has come, its junk so
    far and the bytes of its open frame. An open frame longer than `most` is an error; it is dropped as junk, and the stream goes on.
    The number of groups must stay the same for a checkpoint.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {name: (bytes(buffer), consumed, discarded) for name, buffer, consumed, discarded in state.get[0]} if state.exists else {}
        out: list[tuple] = []
        rows = pd.concat(list(batches)).sort_values("number", kind="stable")
        for stream, piece in zip(rows["stream"], rows["bytes"], strict=True):
            found, buffer, consumed, discarded = push(*held.get(stream, (b"", 0, 0)), bytes(piece or b""))
            out += [(stream, at, junk, raw, None, None, None) for at, junk, raw in found]
            if len(buffer) > most:
                out.append((stream, consumed, None, None, None, None, "Oversized"))
                consumed, discarded, buffer = consumed + len(buffer), discarded + len(buffer), b""
            held[stream] = buffer, consumed, discarded
        state.update(([(name, *own) for name, own in held.items()],))
        for stream in dict.fromkeys(rows["stream"]):
            buffer, consumed, discarded = held[stream]
            out.append((stream, consumed, None, None, discarded, len(buffer), None))
        frame = pd.DataFrame(out, columns=["stream", "frame_offset", "leading_junk", "raw", "discarded_junk", "pending_bytes", "error"])
        yield frame.astype({c: "Int64" for c in ("frame_offset", "leading_junk", "discarded_junk", "pending_bytes")})

    dealt = pieces.select("stream", "number", "bytes", F.pmod(F.xxhash64("stream"), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
