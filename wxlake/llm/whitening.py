"""PCA whitening of embeddings by two passes over exact integers.

    fit(vectors)               first pass: exact integer sums; second pass: centred outer products; then the eigenvectors
    whitened(vectors, fit)     each vector projected on the leading components

Entries become integers x = floor(scale * c) + offset, so sums S and the count n are exact in any order, and every vector is
centred as (n * x - S) / n, whose numerator is exact too. The first pass leaves a row of sums a task, the second one the
sum of centred outer products of its rows, each by one matrix product a batch; treeAggregate merges them, so the driver
gets the sum of a few square matrices of the vectors' dimension, whatever the number of rows. LAPACK's symmetric solver
finds the eigenvectors there, and the projection, a matrix of dimension x components, is broadcast: its size depends on
the dimension alone. No step shuffles a vector.

Defined cases: null vectors and vectors with a null, NaN or infinite entry, or one whose integer does not fit 62 bits, are left
out; so are those of another length than the most frequent one (the longest of equally frequent ones). Rows with a null or
repeated id count and come out like any other. Components without variance are left out, so constant or empty vectors, a
single row and an empty table yield no rows. A deviation beyond 64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET = 64, 1_000_000
#: Integers beyond this are taken for overflown.
_MOST = float(1 << 62)


@dataclass(frozen=True)
class Fit:
    """What whitening needs: n, the sums S, eigenvalues by falling size, unit eigenvectors as columns, and the trace."""

    n: int
    sums: np.ndarray  # exact Python integers
    values: np.ndarray
    components: np.ndarray
    trace: float
    wide: bool  # n * x may leave 64 bits


def integers(column: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows are usable, where their entries begin, and all entries as integers (0 for unusable ones)."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    entries = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    scaled = np.floor(entries * scale)  # null entries come as NaN
    bad = ~(np.abs(scaled) < _MOST)
    ints = np.where(bad, 0, scaled).astype(np.int64) + offset
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    good = (spoilt[offsets[1:]] == spoilt[offsets[:-1]]) & ~np.asarray(column.is_null())
    return good, offsets, ints


def _matrix(column: pa.Array, size: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector of the given length, and their integers."""
    good, offsets, ints = integers(column, scale, offset)
    rows = np.flatnonzero(good & (np.diff(offsets) == size))
    return rows, ints[offsets[rows][:, None] + np.arange(size)]


def _sums(scale: int, offset: int):
    """n, exact sums, and the largest integer of a task's vectors, by their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            good, offsets, ints = integers(batch.column(0), scale, offset)
            size = np.diff(offsets)
            for d in np.unique(size[good]):
                x = ints[offsets[:-1][good & (size == d)][:, None] + np.arange(d)]
                most = int(np.abs(x).max(initial=0))
                s = x.sum(0) if most < (1 << 62) // max(1, len(x)) else x.astype(object).sum(0)
                n, sums, top = held.get(int(d), (0, 0, 0))
                held[int(d)] = [n + len(x), sums + s.astype(object), max(top, most)]
            if len(held) > 256:  # tables of many lengths: no more than this is kept
                yield _partial(held)
                held = {}
        yield _partial(held)

    return run


def _partial(held: dict[int, list]) -> pa.RecordBatch:
    sums = pa.array([[str(int(s)) for s in v[1]] for v in held.values()], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([str(v[2]) for v in held.values()], pa.string()), sums], names=["size", "n", "most", "sums"])


def centred(x: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """n * x - S of each row, exact: 64-bit integers, or Python's where those could overflow."""
    return x.astype(object) * n - sums if wide else x * np.int64(n) - sums.astype(np.int64)


def _products(make, size: int):
    """One row a task: the sum of z^T z over its vectors, for z = make(integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = make(batch.column(0))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' matrices, merged on the executors level by level."""
    add = lambda a, b: a + b
    return parts.rdd.treeAggregate(np.zeros((size, size)), lambda a, r: a + np.frombuffer(r.part).reshape(size, size), add, depth=2)


def fit(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> Fit | None:
    """Mean and principal components of all usable vectors; None if there are none."""
    own = vectors.select(F.col(column).cast("array<double>").alias("v"))
    parts = common.written(own.transform(common.mapped, _sums(scale, offset), "size int, n long, most string, sums array<string>"), "sums")
    best = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    d, n = best["size"], best["n"]

    def merge(a: tuple, b: tuple) -> tuple:
        return (max(a[0], b[0]), [p + q for p, q in zip(a[1], b[1], strict=True)])

    rows = parts.where(F.col("size") == d).rdd
    most, sums = rows.treeAggregate((0, [0] * d), lambda a, r: merge(a, (int(r.most), [int(s) for s in r.sums])), merge, depth=2)
    common.deleted(parts)
    wide, exact = n * most >= 1 << 61, np.array(sums, object)

    def centre(vector: pa.Array) -> np.ndarray:
        return (centred(_matrix(vector, d, scale, offset)[1], n, exact, wide) / n).astype(float)

    v = _summed(own.transform(common.mapped, _products(centre, d), "part binary"), d) / n
    values, components = np.linalg.eigh(v)
    return Fit(n, exact, values[::-1], components[:, ::-1], float(np.trace(v)), wide)


def whitened(vectors: DataFrame, found: Fit | None, column: str = "embedding", key: str = "vec_id", most: int = 32, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each usable vector and component (1 .. most): key, component, n, deviation, whitened, explained, identity_error.

    identity_error is measured, in one more pass, on the whitened vectors themselves.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(column).cast("array<double>").alias("v"), F.col(key).alias(key))
    out = f"`{key}` {own.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    some = 0 if found is None else int((found.values[:most] > max(found.values[0], 0) * len(found.values) * np.finfo(float).eps).sum()) if len(found.values) else 0
    if not some:
        return spark.createDataFrame([], out)
    n, sums, wide, d = found.n, found.sums, found.wide, len(found.values)
    sent = spark.sparkContext.broadcast(found.components[:, :some] / np.sqrt(found.values[:some]))
    share = found.values[:some] / found.trace

    def project(x: np.ndarray) -> np.ndarray:
        return (x / n).astype(float) @ sent.value

    def scores(vector: pa.Array) -> np.ndarray:
        return project(centred(_matrix(vector, d, scale, offset)[1], n, sums, wide))

    cov = _summed(own.select("v").transform(common.mapped, _products(scores, some), "part binary"), some) / n
    error = float(np.abs(cov - np.eye(some)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(0), d, scale, offset)
            x = centred(x, n, sums, wide)
            z = project(x)
            if wide or float(np.abs(x).max(initial=0)) ** 2 * d >= _MOST:
                apart = [s if s < 1 << 63 else None for s in (sum(int(e) * int(e) for e in row) for row in x)]
            else:
                apart = (x * x).sum(1)
            each = pa.array(np.repeat(np.arange(len(rows)), some))
            many = len(rows) * some
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(rows)).take(each),
                    pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(many, n)),
                    pa.array(apart, pa.int64()).take(each),
                    pa.array(z.ravel()),
                    pa.array(np.tile(share, len(rows))),
                    pa.array(np.full(many, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.transform(common.mapped, run, out)
