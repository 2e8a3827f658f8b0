"""Exact Jaccard join on word shingles by token-combination prefixes.

    linked(docs)    one row a document: its number of shingles and the smallest id that it reaches by links

Shingles (tokens) are ordered from rare to frequent. Two sets that are alike enough share at least `need` tokens, so the
first l tokens that they share lie among the first size - need + l tokens of each: its l-prefix. A shared token that is rare
(less than RARE sets have it) is thus in both 1-prefixes, and rare tokens there are index keys of their own. Otherwise all
shared tokens are frequent, and the prefixes are extended: frequent tokens fall into P classes by hash, and among the
first (k - 1) * P + 1 shared ones k are in the same class. So combinations of k tokens of one class are the keys: P grows
with the size, a class has few tokens of a prefix, and a set has about as many keys as its prefix has tokens. A text that
is mostly its own needs no key for what it quotes. Sizes are banded by powers of two, and a key names the band of the
smaller set. No link is lost: all this is exact.

Plan: (1) One pass over the texts makes blocks of sets; each block asks for the frequency of its tokens, a few bytes each,
dealt by token; a token that many sets of a block have is asked for once. (2) Tokens of two sets or more come back to their
block; what is shared by nobody is a number. The table of sets keeps shared tokens only, in order, which is all that
intersections need. (3) Keys; of each key every member is verified against the smallest one, which connects most
groups of copies in linear work. (4) Keys whose members are still in several components compare members of different
components, in blocks of at most ROWS members, by sizes and by parity bitmaps of their shared tokens, whose Hamming
distance is never above the sets' difference; what is left is verified. (5) Star contraction gives components.

Step 4 is quadratic in the members of a key that are in different components: texts that share most of their frequent shingles
and are not linked. Each pair costs some 40 machine words there and no row.

Defined cases: null texts and those without words have no set and link to nothing; equal sets are one class; sets so small that
one other token is too much link with equal ones only. Rows that share an id are one document; a row without id keeps its
own size and has no component. Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .neardup import components
from .shingles import mix, shingle_sets

#: A token that this many sets have is frequent.
RARE = 16
#: Tokens of a block of sets, and the most sets that it has.
BLOCK_TOKENS, BLOCK_SETS = 1 << 21, 65_000
#: Bytes of text for each range of tokens whose frequencies one group of rows counts.
RANGE_BYTES = 1 << 22
#: Members that are compared with one another at once, partners that one set is verified against at once, words of a bitmap.
ROWS, PARTNERS, WORDS = 2048, 64, 32

_ALL = 0xFFFF  # stands for the place of a token that many sets of its block have
_FIELDS = "ids array<long>, own array<int>, sizes array<int>, keys binary"
REQUEST = f"bucket int, block long, tokens binary, places binary, counts binary, {_FIELDS}"
REPLY = f"block long, tokens binary, places binary, levels binary, {_FIELDS}"
SETS = "doc_id long, n_shingles long, set_key binary, rare int, shared array<long>"


def _packed(values: np.ndarray) -> bytes:
    """The bytes of unsigned integers, plane by plane, so that the leading bytes of sorted ones compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


# --- tokens and their frequencies


class _Block:
    """Documents and their distinct sets, until there are enough tokens."""

    def __init__(self) -> None:
        self.ids, self.own, self.sets, self.at, self.tokens = [], [], [], {}, 0

    def add(self, doc_id: int | None, found: np.ndarray) -> None:
        place = -1
        if len(found):
            key = xxhash.xxh3_128_digest(found.tobytes())
            place = self.at.setdefault(key, len(self.sets))
            if place == len(self.sets):
                self.sets.append(found)
                self.tokens += len(found)
        self.ids.append(doc_id)
        self.own.append(place)

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.sets) >= BLOCK_SETS or len(self.ids) >= 4 * BLOCK_SETS

    def rows(self, block: int, bits: int) -> Iterator[tuple]:
        """Rows of REQUEST: one for each range of tokens, and one with the documents."""
        sizes = [len(s) for s in self.sets]
        tokens = np.concatenate(self.sets) if sizes else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, places = tokens[order], np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([first, [len(tokens)]]))
        often = np.repeat(many >= RARE, many)
        once = ~often
        once[first] = True  # of tokens that are here often, the first entry stands for all
        asked, place = tokens[once], np.where(often[once], _ALL, places[once]).astype(np.uint16)
        count = np.repeat(np.where(many >= RARE, many, 1), np.where(many >= RARE, 1, many))
        bucket = (asked >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(asked), np.int64)
        edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(edge)):
            s = slice(edge[b], edge[b + 1])
            yield (int(b), block, _packed(asked[s]), _packed(place[s]), _packed(count[s][place[s] == _ALL].astype(np.uint32)), None, None, None, None)
        yield (block % (1 << bits), block, _packed(tokens[often]), _packed(places[often]), None, self.ids, self.own, sizes, b"".join(self.at))


def _requests(k: int, bits: int):
    names = [f.split()[0] for f in REQUEST.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[i]) for i in range(9)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, own = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in common.passes(offsets):
                for i, found in enumerate(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)):
                    own.add(ids[lo + i], found)
                    if own.full():
                        yield rows(list(own.rows(part << 24 | number, bits)))
                        number, own = number + 1, _Block()
        if own.ids:
            yield rows(list(own.rows(part << 24 | number, bits)))

    return run


def _levels(asked: list[dict]) -> Iterator[dict]:
    """Of one range's requests: the tokens that two sets or more have, with their level, log2 of how many."""
    tokens = [_unpacked(r["tokens"], np.uint64) for r in asked]
    places = [_unpacked(r["places"], np.uint16) for r in asked]
    every = np.concatenate(tokens)
    count = np.ones(len(every), np.int64)
    count[np.concatenate(places) == _ALL] = np.concatenate([_unpacked(r["counts"], np.uint32) for r in asked])
    order = np.argsort(every, kind="stable")
    inner = every[order]
    first = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
    total = np.add.reduceat(count[order], first)
    level = np.empty(len(every), np.uint8)
    level[order] = np.repeat(np.floor(np.log2(total)).astype(np.uint8), np.diff(np.concatenate([first, [len(every)]])))
    at = 0
    for r, t, p in zip(asked, tokens, places, strict=True):
        own = level[at : at + len(t)]
        at += len(t)
        kept = own > 0
        if kept.any():
            yield r | {"tokens": _packed(t[kept]), "places": _packed(p[kept]), "levels": own[kept].tobytes()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests, ordered by range, to replies; rows with documents pass."""
    names = [f.split()[0] for f in REPLY.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], kind) for n, kind in zip(names, kinds, strict=True)], names=names)

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["ids"] is not None:
                yield rows([r])
                continue
            if held and held[0]["bucket"] != r["bucket"]:
                yield rows(list(_levels(held)))
                held = []
            held.append(r)
    if held:
        yield rows(list(_levels(held)))


def _assembled(block: pa.Table) -> pa.Table:
    """A block's replies to the rows of SETS."""
    rows = block.to_pylist()
    docs = next(r for r in rows if r["ids"] is not None)
    replies = [r for r in rows if r["ids"] is None]
    none = {"tokens": b"", "places": b"", "levels": b""}
    token, place, level = (np.concatenate([_unpacked(r[c], kind) for r in replies or [none]]) for c, kind in (("tokens", np.uint64), ("places", np.uint16), ("levels", np.uint8)))
    often = place == _ALL
    # What is here often is told once; its places were kept with the documents.
    order = np.argsort(token[often])
    known, rank = token[often][order], level[often][order]
    more, at = _unpacked(docs["tokens"], np.uint64), _unpacked(docs["places"], np.uint16)
    token = np.concatenate([token[~often], more])
    place = np.concatenate([place[~often], at])
    level = np.concatenate([level[~often], rank[np.searchsorted(known, more)]])
    order = np.lexsort((token, level, place))
    token, place, level = token[order], place[order], level[order]
    n = len(docs["sizes"])
    edge = np.searchsorted(place, np.arange(n + 1))
    rare = np.concatenate([[0], np.cumsum(level < log2(RARE))])
    first = {}
    for i, (doc, own) in enumerate(zip(docs["ids"], docs["own"], strict=True)):
        if own >= 0 and (own not in first or (doc is not None and (docs["ids"][first[own]] is None or doc < docs["ids"][first[own]]))):
            first[own] = i
    out = []
    for i, (doc, own) in enumerate(zip(docs["ids"], docs["own"], strict=True)):
        if own < 0:
            out.append((doc, 0, None, None, None))
        elif first[own] != i:
            out.append((doc, docs["sizes"][own], docs["keys"][16 * own : 16 * own + 16], None, None))
        else:
            s = slice(edge[own], edge[own + 1])
            out.append((doc, docs["sizes"][own], docs["keys"][16 * own : 16 * own + 16], int(rare[s.stop] - rare[s.start]), token[s].view(np.int64)))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
    names = [f.split()[0] for f in SETS.split(", ")]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


def sets(docs: DataFrame, k: int) -> DataFrame:
    """Every document with its number of shingles, the digest of its set, and, at the first document of a set in its block,
    those shingles that another set has too, rare ones first."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, int(size // RANGE_BYTES).bit_length())
    asked = given.transform(common.mapped, _requests(k, bits), REQUEST)
    replies = asked.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").transform(common.mapped, _counted, REPLY)
    return replies.groupBy("block").applyInArrow(_assembled, SETS)


# --- keys


def need(n: np.ndarray, threshold: int) -> np.ndarray:
    """Tokens that a set of n shares with any set that is alike enough."""
    return -(-n * threshold // 100)


def classes(band: int, threshold: int, k: int) -> tuple[int, int]:
    """How many tokens a combination has in a band of sizes, and how many classes there are."""
    least = int(need(np.int64(1 << band), threshold))  # what two sets of the band share at least
    k = min(k, least)
    return k, 1 if k == 1 else max(1, min((100 - threshold) * (1 << band) // 100, (least - 1) // (k - 1)))


def index_keys(n: np.ndarray, rare: np.ndarray, shared: list[np.ndarray], threshold: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some sets: the set's place, and the key."""
    many = np.array([len(s) for s in shared], np.int64)
    token = np.concatenate(shared).view(np.uint64) if len(shared) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(shared)), many)
    place = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
    ahead = many - need(n, threshold)  # tokens of the prefix, less l
    low, high = np.floor(np.log2(need(n, threshold))).astype(int), np.floor(np.log2(n)).astype(int)
    owners, keys = [], []

    def add(at: np.ndarray, parts: list[np.ndarray], salt: int) -> None:
        key = np.full(len(at), salt, np.uint64)
        for p in parts:
            key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + p)
        owners.append(owner[at])
        keys.append(key)

    is_rare = place < rare[owner]
    for band in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        inside = ((low <= band) & (band <= high))[owner]
        size, groups = classes(band, threshold, k)
        single = inside & (place <= ahead[owner]) & (is_rare | (size == 1))
        at = np.flatnonzero(single)
        add(at, [token[at]], 2 * band)
        if size == 1:
            continue
        at = np.flatnonzero(inside & ~is_rare & (place <= ahead[owner] + (size - 1) * groups))
        kind = mix(token[at].copy()) % np.uint64(groups)
        at = at[np.lexsort((token[at], kind, owner[at]))]
        kind = mix(token[at].copy()) % np.uint64(groups)
        group = owner[at] * groups + kind.astype(np.int64)
        longest = int(np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))).max(initial=0)) if len(at) else 0
        for steps in combinations(range(1, longest), size - 1):
            start = np.flatnonzero(group[steps[-1] :] == group[: len(group) - steps[-1]])
            add(at[start], [token[at[start + s]] for s in (0, *steps)], 2 * band + 1)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def _lists(column: pa.Array) -> list[np.ndarray]:
    column = column.cast(pa.large_list(pa.int64()))
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _keyed(threshold: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, key = index_keys(batch.column(1).to_numpy(), batch.column(2).to_numpy(), _lists(batch.column(3)), threshold, k)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(owner))], names=["key", "id"])

    return run


# --- verification


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens of b are in the sorted a."""
    if not len(a):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _confirmed(threshold: int):
    """Rows (u, part, side, id, n, shared), each u's own set (side 0) before its partners', to the links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = [], None
        for batch in batches:
            u, part, side, ids, n = (batch.column(i).to_pylist() for i in range(5))
            found: list[tuple[int, int]] = []
            for i, tokens in enumerate(_lists(batch.column(5))):
                if (u[i], part[i]) != key:
                    key, own = (u[i], part[i]), []
                if side[i] == 0:
                    own.append((n[i], np.sort(tokens)))
                    continue
                for m, base in own:
                    both = _meet(base, tokens)
                    if 100 * both >= threshold * (m + n[i] - both):
                        found.append((u[i], ids[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(2)], names=["u", "v"])

    return run


def verified(pairs: DataFrame, active: DataFrame, threshold: int) -> DataFrame:
    """The distinct pairs (u, v) whose sets are alike enough; a set with many partners is sent to several groups of them."""
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), F.col("v").alias("id"))
    hubs = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("u").alias("id"))
    rows = dealt.unionByName(hubs).join(active.select("id", "n", "shared"), "id").select("u", "part", "side", "id", "n", "shared")
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", "side").transform(common.mapped, _confirmed(threshold), "u long, v long").distinct()


# --- what one member of a key does not settle


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of how many tokens fall on each of 64 * WORDS bits."""
    bit = mix(tokens.view(np.uint64).copy()) % np.uint64(64 * WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * WORDS) % 2 == 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = _lists(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([bitmap(x).tobytes() for x in lists], pa.binary())], names=["id", "n", "r", "bits"])


def possible(n: np.ndarray, r: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs (a, b) of sets may be alike enough: never false for one that is."""
    both = n[a] + n[b]
    # Sets whose difference is d share (n + m - d) / 2 tokens.
    most = both * (100 - threshold) // (100 + threshold)
    left = most - (n[a] - r[a]) - (n[b] - r[b])
    ok = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * threshold) & (left >= 0)
    some = np.flatnonzero(ok)
    for lo in range(0, len(some), 1 << 16):
        s = some[lo : lo + (1 << 16)]
        ok[s] = np.bitwise_count(bits[a[s]] ^ bits[b[s]]).sum(1, dtype=np.int64) <= left[s]
    return ok


def _compared(threshold: int):
    """Rows (key, i, j, x, id, root, n, r, bits), ordered by key, i, j, to pairs of members with different roots: of blocks i and j
    where they differ, else within the block."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        x, ids, root, n, r = (rows.column(c).to_numpy() for c in ("x", "id", "root", "n", "r"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(ids), WORDS)
        run = np.flatnonzero(np.concatenate([[True], _changes(rows), [True]]))
        end = np.repeat(run[1:], np.diff(run))
        cross = (rows.column("i").to_numpy() != rows.column("j").to_numpy())
        found = []
        for step in range(1, int(np.diff(run).max(initial=1))):
            a = np.flatnonzero(np.arange(len(ids)) + step < end)
            b = a + step
            a = a[keep := (root[a] != root[b]) & (~cross[a] | (x[a] != x[b]))]
            b = b[keep]
            good = possible(n, r, bits, a, b, threshold)
            found.append(np.stack([np.minimum(ids[a[good]], ids[b[good]]), np.maximum(ids[a[good]], ids[b[good]])], 1))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            ends = np.flatnonzero(_changes(table))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last run may go on in the next batch
            if cut:
                yield pairs(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and len(held):
            yield pairs(held)

    return run


def _changes(rows: pa.Table) -> np.ndarray:
    key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
    return (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])


def unsettled(keys: DataFrame, roots: DataFrame, active: DataFrame, threshold: int) -> DataFrame:
    """Pairs of members of one key that are in different components and may be alike enough.

    Members of a key's most frequent component (its top) need not meet one another: the others' blocks meet all blocks, the top's
    only those of the others. Where at most ROWS members are outside the top, rows grow with the members.
    """
    bits = active.select("id", "n", "shared").transform(common.mapped, _bitmaps, "id long, n long, r long, bits binary")
    rows = _dealt(keys, roots).join(bits, "id").select("key", "i", "j", "x", "id", "root", "n", "r", "bits")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").transform(common.mapped, _compared(threshold), "u long, v long").distinct()


def _dealt(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, i, j, x, id, root) of keys with several roots, once for each pair of blocks i <= j that they are in; x is their
    own block."""
    rooted = keys.join(roots, keys.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    several = counts.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("most")).where("m > most.c")
    blocks = lambda n: F.ceil(n / ROWS).cast("int")
    # What fits one block is one, top and others together.
    several = several.select("key", F.col("most.root").alias("top"), blocks(F.col("m") - F.col("most.c")).alias("others"), F.when(F.col("m") > ROWS, blocks(F.col("most.c"))).otherwise(0).alias("own"))
    at_top, place = (F.col("root") == F.col("top")) & (F.col("own") > 0), F.xxhash64("id", F.lit("block"))
    x = F.when(at_top, F.col("others") + F.pmod(place, F.greatest("own", F.lit(1)))).otherwise(F.pmod(place, "others")).cast("int")
    met = F.col("others") + F.when(at_top, 0).otherwise(F.col("own"))
    members = rooted.join(several, "key").withColumn("x", x).withColumn("y", F.explode(F.sequence(F.lit(0), met - 1)))
    return members.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "root")


def linked(docs: DataFrame, k: int = 5, threshold: int = 80, combination: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id of each row. threshold is in hundredths: two sets are linked when
    100 * |intersection| >= threshold * |union|."""
    every = common.written(sets(docs, k), "sets")
    whole = every.where("doc_id is not null and set_key is not null")
    one = whole.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    enough = (F.size("shared") * 100 >= F.col("n_shingles") * threshold) & (F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * threshold)
    first = whole.where("shared is not null").where(enough).join(one, (whole.doc_id == one.id) & (whole.set_key == one.set_key), "left_semi")
    # By the join's own columns, so that repeated rows go without a second shuffle of the sets.
    first = first.dropDuplicates(["doc_id", "set_key"])
    active = common.written(first.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "rare", "shared"), "active")

    found = common.written(active.transform(common.mapped, _keyed(threshold, combination), "key long, id long").distinct(), "keys")
    least = found.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("hi")).where("u < hi").select("key", "u")
    keys = common.written(found.join(least, "key"), "shared_keys")
    stars = common.written(keys.where("id > u").select("u", F.col("id").alias("v")).distinct(), "pairs")
    links = common.written(verified(stars, active, threshold), "links")

    # Rows of one id with different texts are one document.
    known = whole.select("doc_id", "set_key").join(one, "set_key").select("doc_id", "id")
    torn = known.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("hi")).where("u < hi").select("doc_id", "u")
    joined = common.written(known.join(torn, "doc_id").select("u", F.col("id").alias("v")).where("u < v").distinct(), "joined")

    roots = components(links.unionByName(joined))
    more = common.written(verified(unsettled(keys, roots, active, threshold).join(stars, ["u", "v"], "left_anti"), active, threshold), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(joined).unionByName(more))
    common.deleted(found, keys, stars, active)

    member = every.select("doc_id", "n_shingles", "set_key").join(one, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id"))
    return member.join(roots, member.id == roots.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
