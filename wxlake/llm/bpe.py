"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the last WINDOW bytes cuts every text where the hash's low bits are zero, so equal
passages fall into equal chunks wherever they stand. Each Python worker encodes a chunk once, from the ids of its words,
which are kept too, and keeps the ids and tokens of its inner words; copies and shared passages then cost a look-up. A cut
can fall inside a word, so the joins are repaired: the two fragments at a join (all of a chunk that has no inner blank) are
encoded together with the word on either side, whose ids must be those that the chunks gave them. While they differ the
window grows, by twice as many words each time, and is encoded again, until its outer words agree or it is the whole text.

Chunks are not exchanged between machines: shuffling every chunk twice would move more bytes than the
texts hold. Kept chunks are bounded (KEEP bytes a worker). Texts with unusual white space or special-token
strings are encoded whole.

Decoding joins tokens as the library's decode without a decoder does, with single blanks; the operator's
`decode` is checked against it by tests. Defined cases: a null text is empty; repeated rows and null ids
yield a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Words, pieces, whole

WINDOW = 16
#: A cut every 2**MASK_BITS bytes on average, and the bytes that a worker's chunks and joins may take.
MASK_BITS, KEEP = 9, 40 << 20
_BLANK, _LAST_BLANK = re.compile(r"[ \t\r\n]+"), re.compile(r"[ \t\r\n]+(?=[^ \t\r\n]*\Z)")
_WORD = re.compile(rb"[^ \t\r\n]+")
_workers: dict[str, "Codec"] = {}


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a UTF-8 text: where the rolling hash of the last bytes says so, between characters."""
    n = len(raw)
    if n <= WINDOW:
        return np.array([n])
    mixed = (raw.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h = np.zeros(n - WINDOW + 1, np.uint32)
    for j in range(WINDOW):  # shifted sums: the hash of bytes i .. i + WINDOW - 1
        h += mixed[j : n - WINDOW + 1 + j] << np.uint32(WINDOW - 1 - j)
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32((1 << MASK_BITS) - 1)) == 0) + WINDOW
    at = at[at < n]
    at = at[(raw[at] & 0xC0) != 0x80]
    return np.append(at, n)


class Part(NamedTuple):
    """How many ids, the ids as decimal text, and decoded; both with single blanks between."""

    n: int
    said: str
    decoded: str


class Chunk(NamedTuple):
    """Fragments before the first and after the last blank (all of it is `first` without one), the words between
    them, and the first and last of these."""

    first: str
    tail: str
    blank: bool
    inner: Part
    head: str
    last: str


def _together(parts: list[Part]) -> Part:
    return Part(sum([p.n for p in parts]), " ".join([p.said for p in parts]), " ".join([p.decoded for p in parts]))


class Codec:
    """Encodes and decodes texts with the chunks and words that this worker keeps."""

    def __init__(self, path: str) -> None:
        self.words = Words(path, self._part)
        self.tokenizer = self.words.tokenizer
        top = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(top)]
        self.number = [str(i) for i in range(top)]
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[tuple[str, str, str], Part | None] = {}
        self.size = 0

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _part(self, ids: Sequence[int]) -> Part:
        return Part(len(ids), " ".join([self.number[i] for i in ids]), self.decode(ids))

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    def _learn_chunks(self, raws: list[bytes]) -> None:
        new = [r for r in dict.fromkeys(raws) if r not in self.chunks]
        split = []
        for raw in new:
            text = raw.decode()
            first, last = _BLANK.search(text), _LAST_BLANK.search(text)
            split.append((text, "", "", False) if first is None else (text[: first.start()], text[last.end() :], text[first.end() : last.start()], True))
        parts = [pieces(inner) for _, _, inner, _ in split]
        made = self.words.look_up([w for own in parts for w in own])
        at = 0
        for raw, own, (first, tail, inner, blank) in zip(new, parts, split, strict=True):
            together = _together(made[at : at + len(own)])
            at += len(own)
            self.chunks[raw] = Chunk(first, tail, blank, together, inner.split(None, 1)[0] if own else "", inner.rsplit(None, 1)[-1] if own else "")
            self.size += 5 * len(raw) + 600

    def _learn_joins(self, keys: list[tuple[str, str, str]]) -> None:
        """Encode each join with the words beside it; None where those disagree with what their chunks gave them."""
        new = [k for k in dict.fromkeys(keys) if k not in self.joins]
        own = [pieces(w) for before, _, after in new for w in (before, after)]
        made = iter(self.words.look_up([w for parts in own for w in parts]))
        beside = [_together([next(made) for _ in parts]) for parts in own]
        for i, (key, ids) in enumerate(zip(new, self.words.ids([" ".join(k) for k in new]), strict=True)):
            left, right = beside[2 * i].n, beside[2 * i + 1].n
            edge = _together([p for p in (beside[2 * i], self._part(ids[left : len(ids) - right]), beside[2 * i + 1]) if p.n])
            self.joins[key] = self._part(ids[left : len(ids) - right]) if self._part(ids) == edge else None
            self.size += 600

    def _repaired(self, text: bytes, ends: list[int]) -> list[Part]:
        """A text's words, with windows around its chunk ends encoded anew and grown until their outer words agree."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].decode() for a, b in spans]
        split = [pieces(w) for w in words]
        made = iter(self.words.look_up([p for own in split for p in own]))
        given = [_together([next(made) for _ in own]) for own in split]
        windows: list[tuple[int, int, Part]] = []  # first and last word, and their ids
        for end in ends[:-1]:
            at = bisect_left(spans, end, key=lambda s: s[1])  # the word that the end is in or at
            if at == len(spans) or windows and at < windows[-1][1]:
                continue
            grow = 1
            while True:
                low, high = max(0, at - grow), min(len(spans) - 1, at + grow)
                if windows and low <= windows[-1][1]:
                    low = windows[-1][0]
                ids = self.words.ids([text[spans[low][0] : spans[high][1]].decode()])[0]
                left, right = given[low], given[high]
                if (low == 0 or self._part(ids[: left.n]) == left) and (high == len(spans) - 1 or self._part(ids[len(ids) - right.n :]) == right):
                    break
                grow *= 2
            while windows and low <= windows[-1][1]:
                windows.pop()
            windows.append((low, high, self._part(ids)))
        out, done = [], 0
        for low, high, part in windows:
            out += [*given[done:low], part]
            done = high + 1
        return out + given[done:]

    def encode(self, texts: list[str], raw: np.ndarray, offsets: np.ndarray) -> list[list[Part]]:
        """The ids of each text in parts; none is empty. raw and offsets: the texts' bytes."""
        if self.size > KEEP:
            self.chunks.clear()
            self.joins.clear()
            self.size = 0
        chunks: list[list[bytes]] = []
        for i, text in enumerate(texts):
            own = raw[offsets[i] : offsets[i + 1]]
            if not len(own) or whole(text):
                chunks.append([])
                continue
            data, ends = own.tobytes(), cuts(own).tolist()
            chunks.append([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        self._learn_chunks([r for own in chunks for r in own])
        plans: list[list] = []
        for own in chunks:
            plan: list = []
            joint, last = "", ""
            for r in own:
                chunk = self.chunks[r]
                joint += chunk.first
                if not chunk.blank:
                    continue
                if joint:
                    plan.append((last, joint, chunk.head))
                    last = joint
                if chunk.inner.n:
                    plan.append(chunk.inner)
                    last = chunk.last
                joint = chunk.tail
            if joint:
                plan.append((last, joint, ""))
            plans.append(plan)
        self._learn_joins([p for plan in plans for p in plan if len(p) == 3 and not isinstance(p, Part)])
        out = []
        for text, own, plan in zip(texts, chunks, plans, strict=True):
            parts = [p if isinstance(p, Part) else self.joins[p] for p in plan] if own or not text else [self._part(self.words.ids([text])[0])]
            if None in parts:
                parts = self._repaired(text.encode(), np.cumsum([len(r) for r in own]).tolist())
            out.append([p for p in parts if p.n])
        return out


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded text of every document."""
    return _coded(docs, tokenizer, digest=False)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, without moving the ids out of the task."""
    return _coded(docs, tokenizer, digest=True)


def _coded(docs: DataFrame, tokenizer: str, digest: bool) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for given in batches:
            _, sizes = common.text_bytes(given.column(1))
            for lo, hi in common.passes(sizes, 4 << 20):
                batch = given.slice(lo, hi - lo)
                raw, offsets = common.text_bytes(batch.column(1))
                rows: list[list] = [[], [], []]
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for parts in codec.encode(texts, raw, offsets):
                    coded = _together(parts)
                    rows[0].append(coded.n)
                    if digest:
                        rows[1].append(hashlib.sha256(coded.said.encode()).hexdigest())
                        rows[2].append(hashlib.sha256(coded.decoded.encode()).hexdigest())
                    else:
                        rows[1].append(list(map(int, coded.said.split())))
                        rows[2].append(coded.decoded)
                second = pa.array(rows[1], pa.string() if digest else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), second, pa.array(rows[2], pa.string())], names=["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kinds = ["string", "string"] if digest else ["array<int>", "string"]
    schema = f"doc_id {kind}, n_tokens long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(common.mapped, run, schema)
