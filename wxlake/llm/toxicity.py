"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training documents, whatever their labels,
is the unlabelled text. With the share p of toxic documents in it, loss l and score g the risk is
    p * E_pos[l(g, +)] + max(0, E_unl[l(g, -)] - p * E_pos[l(g, -)]),
where the second term estimates the risk on negatives and is kept from falling below zero: a mini-batch
on which it does takes a step that raises it again. The model is linear over words and their beginnings,
trained in numpy on the driver with Adam.

Fitting reads a repeatable sample of at most about `most_positive` toxic and `most_unlabelled` training
documents (documented bounds). Features are the at most `features` words and beginnings whose
document frequency among the positives is at least LEAST_RATIO times that among the unlabelled and exceeds
it most significantly; their value is the square root of their occurrences in a hundred words, 9 at most,
with texts of fewer than 30 words counting as 30. Scoring covers every whole text.

Result: score in (0, 1), 0.5 and more predicts toxic. Null and empty texts get the model's bias; without
confirmed toxic documents every score is 0. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import _LOWER, mix, span_hashes

#: Hashes of words and word beginnings are kept modulo this.
SPACE_BITS = 22
#: Bytes of a word's beginnings that are features besides the word.
BEGINNINGS = (4, 5, 6, 7)
#: A feature is in at least so many positives, so many times as often as among the unlabelled, and by so
#: many standard errors more often.
LEAST_POSITIVES, LEAST_RATIO, LEAST_Z = 3, 2.5, 4.0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    """slot: hash -> feature (0: none, else index + 1); weights per feature; bias."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for lo, hi in common.passes(offsets):
            text, feature, value = _features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], self.slot)
            out[lo:hi] += np.bincount(text, weights=self.weights[feature] * value, minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the hash of each word and word beginning, and the words of each text. Words are runs of letters or bytes beyond ASCII."""
    n = len(raw)
    letter = _LETTER[_LOWER[raw]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]])[:n] & ~edge[:n]
    after = np.concatenate([letter[1:], [False]])[:n] & ~edge[1:]
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    texts, hashes = [text], [span_hashes(raw, starts, ends)]
    for k in BEGINNINGS:
        longer = ends - starts >= k + 2
        texts.append(text[longer])
        hashes.append(mix(span_hashes(raw, starts[longer], starts[longer] + k) + np.uint64(k)))
    words = np.bincount(text, minlength=len(offsets) - 1)
    return np.concatenate(texts), (np.concatenate(hashes) & np.uint64((1 << SPACE_BITS) - 1)).astype(np.int64), words


def _features(raw: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value, by text and feature."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text, h, words = _hashes(raw, offsets)
    feature = slot[h].astype(np.int64)
    some = feature > 0
    pair, count = np.unique(text[some] * len(slot) + feature[some] - 1, return_counts=True)
    text = pair // len(slot)
    rate = 100 * count / np.maximum(words, 30)[text]
    return text, pair % len(slot), np.sqrt(np.minimum(rate, 9))


def _frequencies(raw: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """In how many of the chosen texts each hash occurs."""
    out = np.zeros(1 << SPACE_BITS, np.int32)
    for lo, hi in common.passes(offsets):
        if hi > lo and offsets[hi] > offsets[lo]:
            text, h, _ = _hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            good = chosen[lo:hi][text]
            pair = np.unique((text[good] << SPACE_BITS) | h[good])
            own, count = np.unique(pair & ((1 << SPACE_BITS) - 1), return_counts=True)
            out[own] += count.astype(np.int32)
    return out


def nnpu(text: np.ndarray, feature: np.ndarray, value: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, n_features: int, epochs: int = 60, batches: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 9) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk of a linear model with the logistic loss. text is sorted.

    A mini-batch has some 50 positives at least, or all: of fewer, the risk on negatives is below zero by chance too often
    and training goes back and forth. The number of steps stays the same.
    """
    n, steps = len(positive), epochs * batches
    batches = min(batches, max(1, int(positive.sum()) // 50))
    draw = np.random.default_rng(seed)
    first, last = np.searchsorted(text, np.arange(n)), np.searchsorted(text, np.arange(n), "right")
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    step = 0
    where = [np.flatnonzero(positive), np.flatnonzero(unlabelled)]
    for _ in range(-(-steps // batches)):
        parts = [np.array_split(draw.permutation(x), batches) for x in where]
        for pos, unl in zip(*parts, strict=True):
            if not len(pos) or not len(unl):
                continue
            rows = np.concatenate([pos, unl])
            size = (last - first)[rows]
            at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            owner, f, x = np.repeat(np.arange(len(rows)), size), feature[at], value[at]
            g = w[-1] + np.bincount(owner, weights=w[f] * x, minlength=len(rows))
            sig = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            loss_neg = np.logaddexp(0, g)
            k = len(pos)
            negative = loss_neg[k:].mean() - prior * loss_neg[:k].mean()
            # d l(g,+) = sig - 1, d l(g,-) = sig
            slope = np.empty(len(rows))
            if negative >= 0:
                slope[:k] = prior * (sig[:k] - 1 - sig[:k]) / k
                slope[k:] = sig[k:] / len(unl)
            else:
                slope[:k] = prior * sig[:k] / k
                slope[k:] = -sig[k:] / len(unl)
            grad = np.append(np.bincount(f, weights=slope[owner] * x, minlength=n_features), slope.sum()) + decay * np.append(w[:-1], 0)
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = 2500, most_unlabelled: int = 7500, features: int = 2000) -> Model | None:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic). Without `prior` it is the share of toxic
    documents among the labelled ones, or 0.1 if only toxic ones are labelled."""
    verdict = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    ids = rows.select("doc_id").distinct().join(verdict, "doc_id", "left").select("doc_id", "toxic")
    n = ids.agg(F.count("*").alias("all"), F.count("toxic").alias("labelled"), F.count(F.when(F.col("toxic"), 1)).alias("positive")).first()
    if not n["positive"]:
        return None
    if prior is None:
        prior = n["positive"] / n["labelled"] if n["positive"] < n["labelled"] else 0.1
    prior = min(max(prior, 0.005), 0.9)
    positive = F.coalesce("toxic", F.lit(False)) & common.sample_below("doc_id", most_positive / n["positive"])
    chosen = ids.select("doc_id", positive.alias("positive"), common.sample_below("doc_id", most_unlabelled / n["all"]).alias("unlabelled")).where("positive or unlabelled")
    widest = max(most_positive / n["positive"], most_unlabelled / n["all"])
    got = rows.where(common.sample_below("doc_id", widest)).join(F.broadcast(chosen), "doc_id")  # the chosen ids are bounded
    arrow = got.select("positive", "unlabelled", "text").toArrow().combine_chunks()
    if not arrow.num_rows:
        return None
    column = arrow.column("text")
    raw, offsets = common.text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    model = learn(raw, offsets, *(np.array(arrow.column(c).to_pylist(), bool) for c in ("positive", "unlabelled")), prior, features)
    del arrow, column, raw, offsets
    common.give_back()
    return model


def learn(raw: np.ndarray, offsets: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, features: int = 2000) -> Model | None:
    """Choose the features and fit their weights; None without both kinds of texts."""
    n_pos, n_unl = positive.sum(), unlabelled.sum()
    if not n_pos or not n_unl:
        return None
    in_pos = _frequencies(raw, offsets, positive)
    some = np.flatnonzero(in_pos >= LEAST_POSITIVES)
    p, u = in_pos[some] / n_pos, _frequencies(raw, offsets, unlabelled)[some] / n_unl
    z = np.where(p < LEAST_RATIO * u, 0, (p - u) / np.sqrt(np.maximum(u, 0.5 / n_unl) * (1 / n_pos + 1 / n_unl)))
    best = np.argsort(-z, kind="stable")[:features]
    best = some[best[z[best] >= LEAST_Z]]
    slot = np.zeros(1 << SPACE_BITS, np.uint16)
    slot[best] = np.arange(1, len(best) + 1)
    found = []
    for lo, hi in common.passes(offsets):
        t, f, x = _features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], slot)
        found.append((t + lo, f, x))
    w, b = nnpu(*map(np.concatenate, zip(*found, strict=True)), positive, unlabelled, prior, len(best))
    return Model(slot, w, b)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.scores(*common.text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(common.mapped, run, f"doc_id {kind}, score double, predicted int")


def not_toxic(docs: DataFrame, model: Model | None, limit: float = 0.5) -> DataFrame:
    """The documents, columns unchanged, that score below `limit`."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.scores(*common.text_bytes(batch.column(place))) < limit))

    return docs.transform(common.mapped, run, docs.schema)
