"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the bytes that followed every context of up to `order` bytes. In a
context with n counts over d distinct bytes, a byte seen c times has probability c / (n + d) and the
escape to the next shorter context d / (n + d); below the empty context all 256 bytes are equally likely.
A-Z count as a-z. Statistics are frozen after training, so the cost of a byte depends on its last `order` bytes alone and
the trees of all languages flatten into one table: (longest known context, byte) -> bits per language.
A text's code length is a sum of table entries, exact and without a loop over bytes.

Fitting: counts are summed by Spark over a repeatable sample of at most about `train_docs` labelled
documents of each language (a documented bound; scoring always covers every whole text), and contexts
seen fewer than `least` times are left out of the trees; with many languages `least` grows until the table, which is
broadcast, fits MOST_BYTES.

Result: lang_pred is the language of the shortest code (ties: the first by name), score its posterior
under equal priors. `und` with score 0 for texts that are null or have no letter, and if nothing was
learnt. The posterior is relative to the learnt languages; limits on the absolute code length (2.5 times the
bits a byte that 99 % of the language's training documents stay below) tell texts in none of them.
Text before the first byte counts as an unknown byte. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Bits that a text may exceed its limit by, so that a number or a key does not reject a short text.
SLACK_BITS = 512
#: Bytes of the table that every executor holds: languages times contexts times symbols times 4.
MOST_BYTES = 256 << 20


@dataclass
class Model:
    """langs: names; symbol: byte -> symbol (0: unknown byte or start of text); node: last three symbols
    -> longest known context; bits: (context * symbols + symbol, language) -> code length; limits: bits a
    byte that a text of each language has at most, if they were learnt."""

    langs: list[str]
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray
    limits: np.ndarray | None = None

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        size = int(self.symbol.max()) + 1
        for lo, hi in common.passes(offsets):
            own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if not len(own):
                continue
            s = self.symbol[own].astype(np.int64)
            back = []
            for k in (1, 2, 3):
                b = np.zeros_like(s)
                b[k:] = s[:-k]
                for j in range(k):  # nothing precedes a text
                    starts = at[:-1] + j
                    b[starts[starts < at[1:]]] = 0
                back.append(b)
            row = self.node[(back[2] * size + back[1]) * size + back[0]].astype(np.int64) * size + s
            some = np.flatnonzero(np.diff(at))
            for i in range(len(self.langs)):
                out[lo + some, i] = np.add.reduceat(self.bits[i][row], at[:-1][some], dtype=np.float64)
        return out


def _grams(order: int):
    """Counts of the (order + 1)-grams of bytes of each language in a batch; 0 stands before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            langs = batch.column(0).to_pylist()
            found: dict[str, list[np.ndarray]] = {}
            for i, lang in enumerate(langs):
                text = np.concatenate([np.zeros(order, np.uint64), raw[offsets[i] : offsets[i + 1]].astype(np.uint64)])
                n = len(text) - order
                gram = np.zeros(n, np.uint64)
                for j in range(order + 1):
                    gram = (gram << np.uint64(8)) | text[j : j + n]
                found.setdefault(lang, []).append(gram)
            for lang, parts in found.items():
                gram, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def fit(labelled: DataFrame, train_docs: int = 2000, order: int = 3, least: int = 2, limits: bool = False) -> Model | None:
    """Learn from the columns doc_id, text and lang, on request with limits; None if no row has a language and a text."""
    if order != 3:
        raise ValueError("the flat table holds contexts of three bytes")
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    chosen = None
    for lang, n in sorted(sizes.items()):
        one = (F.col("lang") == lang) & common.sample_below("doc_id", train_docs / n)
        chosen = one if chosen is None else chosen | one
    counts = rows.where(chosen).select("lang", "text").transform(common.mapped, _grams(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    model = build(sorted(sizes), *(counts.column(c).to_numpy() for c in ("lang", "gram", "n")), least)
    del counts
    common.give_back()
    return replace(model, limits=_limits(rows.where(chosen), model)) if limits else model


def _limits(rows: DataFrame, model: Model, factor: float = 2.5) -> np.ndarray:
    """By language, the limit from the bits a byte of its training documents."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            own = np.array([m.langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
            size = np.diff(offsets)
            rate = m.lengths(raw, offsets)[np.arange(len(own)), own] / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate)], names=["lang", "rate"]).filter(pa.array(size > 0))

    rates = rows.select("lang", F.col("text").cast("string").alias("text")).transform(common.mapped, run, "lang string, rate double")
    found = {r["lang"]: r["p"] for r in rates.groupBy("lang").agg(F.percentile_approx("rate", 0.99, 10_000).alias("p")).collect()}
    return np.array([factor * found.get(x, np.inf) for x in model.langs])


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, least: int = 2, most_bytes: int = MOST_BYTES) -> Model:
    """Flatten the context trees of the 4-gram counts. `least` is doubled until the table fits `most_bytes`."""
    code = np.searchsorted(np.array(langs, object), lang) if len(lang) else np.zeros(0, np.int64)
    raws = np.stack([(gram >> (8 * j)) & 255 for j in (3, 2, 1, 0)]) if len(gram) else np.zeros((4, 0), np.int64)
    fold = np.arange(256)
    fold[65:91] += 32
    used = np.unique(fold[raws[3]])
    symbol = np.zeros(256, np.uint8)
    symbol[used] = np.arange(1, len(used) + 1)
    symbol = symbol[fold]
    size = len(used) + 1
    p3, p2, p1, s = symbol[raws].astype(np.int64)
    contexts = [np.zeros_like(s), p1, p2 * size + p1, (p3 * size + p2) * size + p1]

    seen = [np.unique(c, return_inverse=True) for c in contexts]
    often = [np.bincount(where, weights=n, minlength=len(value)) for value, where in seen]
    while 4 * len(langs) * size * (1 + sum(int((o >= least).sum()) for o in often[1:])) > most_bytes and any((o >= least).any() for o in often[1:]):
        least *= 2

    # Contexts of each length that are frequent enough, and their rows in the table; row 0 is the empty one.
    node = np.zeros((size, size, size), np.int32)
    rows, at = [np.zeros(1, np.int64)], 1
    parents = [np.zeros(1, np.int64)]
    for k in (1, 2, 3):
        kept = seen[k][0][often[k] >= least]
        ids = np.arange(at, at + len(kept))
        flat = node.reshape(-1, size**k)
        parents.append(flat[0, kept].astype(np.int64) if len(kept) else kept)
        flat[:, kept] = ids
        rows.append(kept)
        at += len(kept)
    bits = np.empty((len(langs), at * size), np.float32)
    for i in range(len(langs)):
        own = code == i
        prob = np.full((at, size), 1 / 256)
        base = 0
        for k in range(4):
            m = len(rows[k])
            place = np.searchsorted(rows[k], contexts[k][own])
            place = np.minimum(place, max(0, m - 1))
            known = (rows[k][place] == contexts[k][own]) if m else np.zeros(own.sum(), bool)
            count = np.bincount(place[known] * size + s[own][known], weights=n[own][known], minlength=m * size).reshape(m, size)
            total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            shorter = prob[parents[k]] if k else np.full((1, size), 1 / 256)
            some = total > 0
            mixed = np.where(count > 0, count, distinct * shorter) / np.where(some, total + distinct, 1)
            prob[base : base + m] = np.where(some, mixed, shorter)
            base += m
        bits[i] = -np.log2(prob).reshape(-1)
    return Model(langs, symbol, node.reshape(-1), bits)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte (under the predicted language) of every document."""
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kind = dict(given.dtypes)["doc_id"]
    if model is None:
        return given.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most order-3 contexts of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            lengths = m.lengths(raw, offsets)
            best = lengths.argmin(1)
            least = lengths[np.arange(len(best)), best]
            odds = np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
            letter = np.array(batch.column(2).to_pylist(), bool)
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], pa.string()),
                    pa.array(np.where(letter, 1 / odds, 0.0)),
                    pa.array(np.where(letter, least / np.maximum(size, 1), np.nan), mask=~letter),
                ],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return given.transform(common.mapped, run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def known_language(docs: DataFrame, model: Model | None, least_score: float = 0.5) -> DataFrame:
    """The documents, columns unchanged, whose language is known with a posterior of `least_score` or more,
    and a code length within the language's limit, if limits were learnt. Where no document has a language, nothing is
    known that could reject one, so all stay that have a letter."""
    if model is None:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    columns = docs.columns
    kinds = docs.schema
    given = docs.select(*columns, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__has_letter"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(place))
            lengths = m.lengths(raw, offsets)
            odds = np.exp2(np.maximum(lengths.min(1)[:, None] - lengths, -1000)).sum(1)
            good = np.array(batch.column(len(columns)).to_pylist(), bool) & (1 / odds >= least_score)
            if m.limits is not None:
                good &= lengths.min(1) <= m.limits[lengths.argmin(1)] * np.diff(offsets) + SLACK_BITS
            yield batch.select(range(len(columns))).filter(pa.array(good))

    return given.transform(common.mapped, run, kinds)
