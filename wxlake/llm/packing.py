"""Packing of token sequences by bin completion.

Pieces have at most `size` tokens, so their lengths are a histogram of at most `size` entries, however
many documents there are. Bin completion runs on the histogram: best fit over all pieces is the incumbent;
around the largest open length, a depth-first branch and bound takes the undominated fillings of the rest
(none that a longer open length could improve) from the fullest on, each as often as it goes and then less
often, and comes back to the others. It cuts what cannot save a sequence: the waste is bounded by the
incumbent's size, and the open pieces by a lower bound. The search ends at the lower bound, when it is
through, or after a budget of steps; the best packing so far is the result. Spark then deals the pieces to
the bins: pieces of one length are numbered in hash buckets (a length that a third of all pieces have is
spread over all buckets), and a number's place follows from the plan by binary search.

Plan: one pass tokenises the texts (each worker keeps the tokens of frequent words), the pieces are written once,
counted, planned and numbered. Defined cases: a null or empty text is one piece that holds the end token;
repeated rows and null ids are packed as they are; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import bytes_of

END = 0
PIECES = "start long, piece int, length long, ids_crc32 long"


#: Enumerations of fillings that a search keeps.
KEPT = 32


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the tokens of each document, cut after every `size`."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc = [], [], [], []
            for i, ids in enumerate(bytes_of(tokenizer, batch.column(1).to_pylist())):
                ids += end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at : at + 4 * size]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            start = pa.array(start, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), start, pa.array(np.asarray(start) // size, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "piece", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(common.mapped, run, f"doc_id {kind}, {PIECES}")


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """Best fit over all pieces, longest first, as (repeats, lengths); bins with equal contents are one group."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    keys: list[int] = []  # rooms with groups, ascending

    def add(room: int, count: int, filling: list[int]) -> None:
        if count:
            if not rooms.setdefault(room, []):
                insort(keys, room)
            rooms[room].append((count, filling))

    for n in map(int, np.flatnonzero(histogram)[::-1]):
        count = int(histogram[n])
        while count:
            at = bisect_left(keys, n)
            if at < len(keys):
                room = keys[at]
                bins, filling = rooms[room].pop()
                if not rooms[room]:
                    keys.pop(at)
            else:  # new sequences for all that is left
                room, bins, filling = size, -(-count // (size // n)), []
            each = room // n
            full = min(bins, count // each)
            rest = count - full * each if full < bins else 0
            add(room - each * n, full, filling + [n] * each)
            add(room - rest * n, int(rest > 0), filling + [n] * rest)
            add(room, bins - full - (rest > 0), filling)
            count -= full * each + rest
    return [group for groups in rooms.values() for group in groups]


def least_sequences(histogram: np.ndarray, size: int) -> int:
    """A lower bound (Martello and Toth's L2): pieces of more than half a sequence cannot share one, and
    those of at least k go only where k is left."""
    n = np.arange(size + 1)
    count, tokens = np.concatenate([[0], np.cumsum(histogram)]), np.concatenate([[0], np.cumsum(histogram * n)])
    half = size // 2
    k = np.arange(half + 1)  # [k, half] small, (half, size - k] middle, above large
    large, middle = count[-1] - count[size - k + 1], count[size - k + 1] - count[half + 1]
    free = middle * size - (tokens[size - k + 1] - tokens[half + 1])
    small = tokens[half + 1] - tokens[k]
    return int((large + middle + np.maximum(0, -(-(small - free) // size))).max())


def fillings(have: np.ndarray, room: int, most: int | None = None) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths) of the fillings of `room`, least waste first, up to a waste of `most`.

    reach[i] has a bit for each sum that lengths from the i-th on can make, so no branch ends in vain.
    """
    lengths = [int(n) for n in np.flatnonzero(have[: room + 1])[::-1]]
    mask, reach = (1 << room + 1) - 1, [1]
    for n in reversed(lengths):
        sums, left, step = reach[-1], min(int(have[n]), room // n), 1
        while left:
            step = min(step, left)
            sums |= sums << n * step & mask
            left -= step
            step *= 2
        reach.append(sums)
    reach.reverse()

    def sets(i: int, total: int) -> Iterator[list[int]]:
        if total == 0:
            yield []
            return
        while reach[i] >> total & 1 and i < len(lengths):
            n = lengths[i]
            for k in range(min(int(have[n]), total // n), 0, -1):
                if reach[i + 1] >> total - k * n & 1:
                    for rest in sets(i + 1, total - k * n):
                        yield [n] * k + rest
            i += 1

    for waste in range(min(room, room if most is None else most) + 1):
        if reach[0] >> room - waste & 1:
            for chosen in sets(0, room - waste):
                yield waste, chosen


def dominated(have: np.ndarray, waste: int, chosen: list[int]) -> bool:
    """Whether a longer open length fits in place of one or more of the chosen, or an equal one in place of several."""
    one = several = 0  # sums of one or more and of two or more
    for n in chosen:
        several |= several << n | one << n
        one |= one << n | 1 << n
    places, width, goal = one << 1, 1, waste
    while width < goal:  # every sum plus 1 to `waste`
        step = min(width, goal - width)
        places |= places << step
        width += step
    places = several | (places if waste else 0)
    kinds, used = np.unique(np.array(chosen, np.int64), return_counts=True)
    have[kinds] -= used
    rest = np.flatnonzero(have)
    have[kinds] += used
    return any(places >> n & 1 or n <= waste for n in map(int, rest))


def complete(have: np.ndarray, room: int) -> list[int]:
    """The filling of `room` with the least waste; have[n] pieces have length n."""
    return next(fillings(have, room))[1]


def plan(histogram: dict[int, int], size: int = 2048, steps: int = 5_000) -> list[tuple[int, list[int]]]:
    """Bins as (repeats, lengths), until no piece is left.

    Exact unless `steps` fillings were looked at before the search was through; the best packing so far is then the result.
    """
    have = np.zeros(size + 1, np.int64)
    for n, count in histogram.items():
        have[n] = count
    best = best_fit(have, size)
    used, least = sum(r for r, _ in best), least_sequences(have, size)
    tokens = int((have * np.arange(size + 1)).sum())

    def options(before: tuple, waste: int) -> Iterator[tuple[int, int, list[int], tuple]]:
        """(repeats, waste, lengths, place in the order) around the longest open length, fullest and most often first.

        Fillings of one longest length are taken in order, so that none of their permutations is tried.
        """
        longest = int(np.flatnonzero(have)[-1])
        open_ = have.copy()
        open_[longest] -= 1
        # A better packing has at least one sequence less, so its waste is bounded.
        for lost, rest in fillings(open_, size - longest, (used - 1) * size - tokens - waste):
            place = (-longest, lost, [-n for n in rest])
            if place <= before or dominated(open_, lost, rest):
                yield 0, lost, rest, place
                continue
            filling = [longest, *rest]
            kinds, each = np.unique(filling, return_counts=True)
            for repeats in range(int((have[kinds] // each).min()), 0, -1):
                yield repeats, lost * repeats, filling, place

    path: list[tuple[int, int, list[int]]] = []
    # Of each open choice: what its fillings come behind, the waste so far, their enumeration, and how many were taken. Enumerations
    # hold a table of sums each, so only the deepest are kept; the search seldom comes back to others, which begin anew then.
    stack: list[list] = [[(-size - 1,), 0, None, 0]]
    while stack and steps and used > least:
        steps -= 1
        here = stack[-1]
        if here[2] is None:
            here[2] = islice(options(*here[:2]), here[3], None)
        option = next(here[2], None)
        here[3] += 1
        if option is None:
            stack.pop()
            if path:
                repeats, _, filling = path.pop()
                np.add.at(have, filling, repeats)
            continue
        repeats, lost, filling, place = option
        waste, sequences = lost + sum(p[1] for p in path), repeats + sum(p[0] for p in path)
        if not repeats or waste > (used - 1) * size - tokens:
            continue
        np.subtract.at(have, filling, repeats)
        if not have.any():
            best, used = [(r, f) for r, _, f in path] + [(repeats, filling)], sequences
        elif sequences + least_sequences(have, size) < used:
            path.append((repeats, lost, filling))
            stack.append([place, waste, None, 0])
            if len(stack) > KEPT:
                stack[-KEPT - 1][2] = None
            continue
        np.add.at(have, filling, repeats)
    return best


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: runs of slots as arrays of first number, first sequence, slots a bin, and the offsets of the slots."""
    runs: dict[int, list] = {}
    numbers: dict[int, int] = {}
    sequence = 0
    for repeats, filling in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in filling:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            runs.setdefault(n, []).append((numbers.get(n, 0), sequence, where))
            numbers[n] = numbers.get(n, 0) + repeats * len(where)
        sequence += repeats
    out = {}
    for n, own in runs.items():
        slots = np.array([len(w) for *_, w in own])
        out[n] = (np.array([r[0] for r in own]), np.array([r[1] for r in own]), slots, np.concatenate([[0], np.cumsum(slots)[:-1]]), np.concatenate([w for *_, w in own]))
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    cut = common.written(pieces(docs, tokenizer, size), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` entries
    layout = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size)))  # as many runs as kinds of bins
    buckets = max(16, sum(counts.values()) // bucket_rows + 1)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id() % 64), F.lit(buckets)))
    dealt = common.written(dealt.withColumn("number", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))), "numbered")
    sizes = dealt.groupBy("length", "bucket").agg(F.max("number").alias("n"))
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number") - 1).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                first, bins, slots, base, where = layout.value[int(n)]
                own = np.flatnonzero(length == n)
                r = np.searchsorted(first, number[own], "right") - 1
                ahead = number[own] - first[r]
                sequence[own] = bins[r] + ahead // slots[r]
                offset[own] = where[base[r] + ahead % slots[r]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.transform(common.mapped, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
