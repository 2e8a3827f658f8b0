"""Repair of conversation structure: the cheapest edits that make the roles `(system? (user assistant)+)?`.

    repaired(turns)    one row a conversation: faults, least cost, its edits, and the digest of the repaired turns

A forward Viterbi pass over each conversation's turns carries, for each of four grammar states, the least (cost, edits):

    0 nothing yet    1 after the system turn    2 after a user turn    3 after an assistant turn (0 and 3 may end)

Each turn's layer first inserts missing turns, two in a row at most, as a third one only comes back to a state that was
cheaper before, and then keeps, re-roles or deletes the turn. In every state but one kind of role may follow, so edits
alone tell the repaired roles. Two ways of equal cost never have edits of which one begins with the other, so the least
string of each state is all that is needed.

The rows of a conversation are brought together by one shuffle on its id and streamed in their order; duplicates are found there
too, by a second sort of the same partition. A task holds no conversation: the ways' edits are cut every BLOCK turns, each
way keeps a digest of its turns up to the cut, and only the turns since then are held. So one conversation with a third of
all rows takes one task's time, as its digest is sequential, but no more memory than its edits, a byte a turn.

Defined cases: a null role or text is one space, a null turn comes first, and null ids are one conversation. Turns with equal
numbers are in the order of role and text. Roles are told by their first character; one that is neither s, u nor a can only
be re-roled or deleted. Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What edits cost; a truncated turn that stays costs BROKEN besides.
RENAME, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: Turns, and bytes of their texts, after which the ways' edits are cut.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
USER, ASSISTANT = "user", "assistant"
#: Of each state: the role to which a turn may be set there and the state behind it.
_NEXT = ((USER, 2), (USER, 2), (ASSISTANT, 3), (USER, 2))
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_LEGAL = {"su", "ua", "au"}
_SPACES = "\t\n\x0b\x0c\r "
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def fault(text: str, again: bool) -> int:
    """The first fault of a turn: blank, said before in the same role, or without an end mark."""
    bare = text.rstrip(_SPACES)
    return BLANK if not bare else DUPLICATE if again else TRUNCATED if bare[-1] not in ".!?" else NONE


class Ways:
    """The least way to each state, over turns fed one by one.

    A way is (cost, rank, tail): tail has the edits since the last cut, and rank the order of what was before it among the
    ways that were alive then. heads[rank] keeps those: the chain of earlier edits, the state and the digest at the cut.
    """

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, int, str]] = {0: (0, 0, "")}
        self.heads: list[tuple] = [(None, 0, hashlib.sha256(), True)]
        self.turns: list[tuple[str, str]] = []
        self.size = 0

    def _opened(self) -> dict[int, tuple[int, int, str]]:
        """The layer closed under insertions."""
        ways = dict(self.ways)
        for _ in range(2):
            for state, (cost, rank, tail) in list(ways.items()):
                to = _NEXT[state][1]
                way = (cost + INSERT, rank, tail + "I")
                if to not in ways or way < ways[to]:
                    ways[to] = way
        return ways

    def feed(self, role: str, text: str, wrong: int) -> None:
        out: dict[int, tuple[int, int, str]] = {}

        def offer(to: int, way: tuple[int, int, str]) -> None:
            if to not in out or way < out[to]:
                out[to] = way

        broken = BROKEN if wrong == TRUNCATED else 0
        for state, (cost, rank, tail) in self._opened().items():
            offer(state, (cost + DELETE, rank, tail + "D"))
            if wrong in (NONE, TRUNCATED):
                offer(_NEXT[state][1], (cost + RENAME + broken, rank, tail + "R"))
                to = _KEPT[state].get(role[:1])
                if to is not None:
                    offer(to, (cost + broken, rank, tail + "K"))
        # What may follow the first two states may also follow the last one, two deletions apart at most.
        if 3 in out:
            out = {s: w for s, w in out.items() if s > 1 or w[0] <= out[3][0] + DELETE}
        self.ways = out
        self.turns.append((role, text))
        self.size += len(text)
        if len(self.turns) >= BLOCK or self.size >= BLOCK_BYTES:
            self._cut()

    def _replayed(self, rank: int, tail: str) -> tuple:
        """Chain, state and digest of a way's head with the edits of its tail added."""
        chain, state, digest, fresh = self.heads[rank]
        digest, turns = digest.copy(), iter(self.turns)
        for edit in tail:
            role, text = ("", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            if edit == "K":
                state = _KEPT[state][role[:1]]
            else:
                role, state = _NEXT[state]
            digest.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            fresh = False
        return (chain, tail), state, digest, fresh

    def _cut(self) -> None:
        heads = sorted({(rank, tail) for _, rank, tail in self.ways.values()})
        at = {head: i for i, head in enumerate(heads)}
        self.ways = {s: (cost, at[rank, tail], "") for s, (cost, rank, tail) in self.ways.items()}
        self.heads = [self._replayed(*head) for head in heads]
        self.turns, self.size = [], 0

    def ended(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the least way that may end."""
        ways = self._opened()
        cost, rank, tail = min(ways[s] for s in (0, 3) if s in ways)
        chain, _, digest, _ = self._replayed(rank, tail)
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        return cost, "".join(reversed(parts)), digest.hexdigest()


class Conversation:
    """Faults and ways of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.ways, self.n, self.before = Ways(), [0] * 4, None
        self.illegal = self.distinct = 0
        self.low = self.high = self.last = None

    def feed(self, turn: int | None, role: str, text: str, again: bool) -> None:
        wrong = fault(text, again)
        self.n[wrong] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += turn != self.last
            self.last = turn
        self.ways.feed(role, text, wrong)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *self.n[1:], self.illegal, *self.ways.ended())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations, each in order, to one row a conversation."""
    names = [f.split()[0] for f in OUT.split(", ")]
    kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    own: Conversation | None = None
    key: int | None = None
    for batch in batches:
        done = []
        for conv, turn, role, text, again, gone in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if own is None or conv != key:
                if own is not None:
                    done.append((key, *own.row()))
                own, key = Conversation(), conv
            if not gone:
                own.feed(turn, role, text, again)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kinds[i]) for i in range(9)], names=names)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], kinds[i]) for i, v in enumerate((key, *own.row()))], names=names)


def repaired(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """Least repair of each conversation of (conv_id, turn, role, text). Rows where `gone` holds only name their conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"))
    rows = rows.repartition("conv_id")
    # Copies of a turn are next to one another, so the first of them is the first in any order of its kind.
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy("turn")
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "text", "again").select("conv_id", "turn", "role", "text", "again", "gone")
    return ordered.transform(common.mapped, _streamed, OUT)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with faults by crc32 of `conv_id:turn` modulo 20 (0 gone, 1 emptied, 2 without end marks, 3 twice, 4 by the
    user), and the column that tells which are gone."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") == 0, "").otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy"), F.col("gone")
