"""Near-duplicate detection: MinHash with tensored banding, links verified on full shingle sets.

Two collections of `bands` small bands (`rows` minhashes each) are drawn. A table key joins one band of
the first with one of the second collection, so bands**2 tables cost only 2 * bands * rows minhashes,
about the square root of what independent tables need. With the defaults a pair of likeness 0.8 shares
a table with probability (1 - (1 - 0.8**3)**16)**2 > 0.9999.

Plan: (1) one pass over the texts yields set digest, bands and a packed sketch; (2) texts with equal sets
collapse to one class; (3) only bands that two classes share are combined into table keys; (4) each class
is checked against its tables' smallest member, which settles most groups of near copies in linear work; (5) tables
whose members are not all connected are split by further bands while they are large, and members with other roots
are checked with a few pivots of each table, which settles most of what (4) left; (6) what is still unsettled is exact: members with different
roots of all tables are compared, none left out, by first bands where these hold few other pairs, in blocks, by sizes and parity bitmaps
of their whole sets, which never turn down a link (ngram_join); a pair costs some 40 machine words there and no row. So
no pair of a table is left out. In the steps before, a check first compares packed sketches (six longs); all intersect the full sets. Components are found by
alternating star contraction. Every step is a join or grouping; nothing is gathered on the driver.

Defined cases: null or wordless texts have no set and link to nothing; rows that share a doc_id are one
document; a row without doc_id keeps its own size, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import mix, shingle_sets

#: Longs of a packed sketch; each holds 16 minhashes of 4 bits.
SKETCH_LONGS = 6
#: Pairs whose sketches agree on fewer of the 96 hashes are not checked in steps 4 and 5: at likeness 0.8 that is more than three
#: standard deviations below what is expected, as 4 bits also agree by chance once in 16.
SKETCH_SLACK = 0.11

FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("a", T.ArrayType(T.LongType())),
        T.StructField("b", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)


def _minhashes(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """n minhashes of each non-empty set, as an array of (n, sets)."""
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.empty((n, len(sets)), np.uint64)
    sizes = [len(s) for s in sets]
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    held = np.empty_like(every)
    for i in range(n):
        np.multiply(every, odd[i], out=held)
        held += add[i]
        out[i] = np.minimum.reduceat(held, at)
    return mix(out)


def _features(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            for lo, hi in common.passes(offsets):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                some = [i for i, s in enumerate(sets) if len(s)]
                columns = {"a": [None] * len(sets), "b": [None] * len(sets), "sketch": [None] * len(sets)}
                if some:
                    h = _minhashes([sets[i] for i in some], 2 * bands * rows, seed)
                    own = h.reshape(2, bands, rows, len(some))
                    key = np.full((2, bands, len(some)), 1, np.uint64)
                    key += np.arange(2 * bands, dtype=np.uint64).reshape(2, bands, 1) * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(rows):
                        key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + own[:, :, r])
                    nibbles = h[np.arange(16 * SKETCH_LONGS) % len(h)] & np.uint64(15)
                    shift = (np.arange(16, dtype=np.uint64) * np.uint64(4)).reshape(1, 16, 1)
                    packed = np.bitwise_or.reduce(nibbles.reshape(SKETCH_LONGS, 16, -1) << shift, axis=1)
                    for name, value in (("a", key[0]), ("b", key[1]), ("sketch", packed)):
                        for i, v in zip(some, value.T.astype(np.int64), strict=True):
                            columns[name][i] = v
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        *(pa.array(columns[c], pa.list_(pa.int64())) for c in ("a", "b", "sketch")),
                    ],
                    names=FEATURES.names,
                )

    return run


def _sets(k: int):
    """Texts to sets, for rows whose set is the expected one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            keys = batch.column(2).to_pylist()
            for lo, hi in common.passes(offsets):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                good = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == keys[lo + i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(good, pa.int64())),
                        pa.array([sets[i].astype(np.int64) for i in good], pa.list_(pa.int64())),
                    ],
                    names=["id", "shingles"],
                )

    return run


def _alike(x: str, y: str) -> Column:
    """How many of the sketches' hashes agree."""
    ones = F.lit(0x1111111111111111)
    differ = []
    for i in range(SKETCH_LONGS):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        differ.append(F.bit_count(d.bitwiseAND(ones)))
    return F.lit(16 * SKETCH_LONGS) - reduce(lambda p, q: p + q, differ)


def _likely(threshold: int, a: str = "", b: str = "_") -> Column:
    """Sizes and sketches allow the likeness."""
    least = int(16 * SKETCH_LONGS * max(0.0, threshold / 100 - SKETCH_SLACK))
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * threshold) & (_alike(f"sketch{a}", f"sketch{b}") >= least)


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (u, v): each node with the smallest node that it can reach (node, root), written.

    Alternating star contraction: every node hangs its larger neighbours, then its smaller ones, on the
    smallest; both steps are a grouping and a join, and rounds grow with the logarithm of the path length.
    """
    edges = common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, common.written(small.where("u <> v").distinct(), "edges")
        common.deleted(before)
        ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        # Done when all are stars: a node hangs on one other, or others hang on it.
        if ends.groupBy("u").agg(F.sum("up").alias("hangs"), F.min("up").alias("leaf")).where("hangs > 1 or (hangs = 1 and leaf = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _table_keys(reps: DataFrame) -> DataFrame:
    """id, key and first band (x) of the tables of each class, from those bands only that another class has too."""
    band = reps.select("id", F.explode(F.concat(F.transform("a", lambda x: F.struct(F.lit(True).alias("first"), x.alias("key"))), F.transform("b", lambda x: F.struct(F.lit(False).alias("first"), x.alias("key"))))).alias("e")).select("id", "e.first", "e.key")
    shared = band.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    own = band.join(shared, "key", "left_semi").groupBy("id").agg(F.collect_set(F.when(F.col("first"), F.col("key"))).alias("a"), F.collect_set(F.when(~F.col("first"), F.col("key"))).alias("b"))
    return own.select("id", F.col("b"), F.explode("a").alias("x")).select("id", "x", F.explode("b").alias("y")).select("id", F.xxhash64("x", "y").alias("key"), "x")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of tables whose members have several roots, with the table's most frequent root (top) and the number of
    rows that have another one (m); written. Groups are summed by root first, so a large table gathers nowhere."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    tables = counts.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("most"))
    tables = tables.select("key", F.col("most.root").alias("top"), (F.col("all") - F.col("most.c")).alias("m")).where("m > 0")
    return common.written(rows.join(tables, "key"), "open")


def _refined(rows: DataFrame, most: int) -> DataFrame:
    """The rows (key, id, root, n, sketch) of open tables, with top and m; tables in which more than `most` rows do not
    have the most frequent root are split.

    A split appends a further band, five of the sketch's minhashes, to the key, so that members that are less alike part
    while a pair of likeness 0.8 stays together in many of its tables. Which band comes first follows from the table's
    first key; each is used once, so tables that none of them splits stay large.
    """
    bands = 3 * SKETCH_LONGS
    masks = F.array(*(F.lit(0xFFFFF << 20 * j) for j in range(3)))
    rows = rows.withColumn("start", F.pmod(F.xxhash64("key", F.lit("start")), F.lit(bands)).cast("int"))
    done: list[DataFrame] = []
    for level in range(bands + 1):
        found = _open(rows)
        done.append(found)
        large = found.where(F.col("m") > most)
        if level == bands or large.isEmpty():
            break
        done[-1] = found.where(F.col("m") <= most)
        band = F.pmod(F.col("start") + level, F.lit(bands))
        nibbles = F.element_at("sketch", F.floor(band / 3).cast("int") + 1).bitwiseAND(F.element_at(masks, band % 3 + 1))
        rows = large.drop("m", "top").withColumn("key", F.xxhash64("key", F.lit(level), nibbles))
    # Read three times by a plan that would otherwise hold every level as often, which the driver plans, tracks and keeps.
    return done[0] if len(done) == 1 else common.written(reduce(DataFrame.unionByName, done), "refined")


def _pivots(rows: DataFrame, most: int) -> DataFrame:
    """Pivots of each table, among its members without the most frequent root: all of them if they are at most `most`,
    which leaves no pair of different roots out, else the `most` that have the smallest salted hashes."""
    own = F.struct("id", "root", "n", "sketch")
    named = [f"p{s}" for s in range(most)]
    other = rows.where(F.col("root") != F.col("top"))
    least = other.where(F.col("m") > most).groupBy("key").agg(*(F.min(F.struct(F.xxhash64("id", "key", F.lit(s)).alias("h"), own.alias("p"))).getField("p").alias(c) for s, c in enumerate(named)))
    pivots = least.select("key", F.explode(F.array_distinct(F.array(*named))).alias("p")).unionByName(other.where(F.col("m") <= most).select("key", own.alias("p")))
    return pivots.select("key", *(F.col(f"p.{c}").alias(f"{c}_") for c in ("id", "root", "n", "sketch")))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 16, rows: int = 3, seed: int = 20, table_rows: int = 32, pivots: int = 2) -> DataFrame:
    """Component of each document: doc_id, n_shingles, component_id, kept.

    table_rows and pivots bound the work of step 5 only; whatever they are, step 6 compares what is left.

    threshold is in hundredths: two sets are linked when 100 * |intersection| >= threshold * |union|.
    """
    from . import ngram_join  # which takes components() from here

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = common.written(given.transform(common.mapped, _features(k, bands, rows, seed), FEATURES), "features")
    whole = feats.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = whole.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    reps = common.written(
        whole.join(classes, (whole.doc_id == classes.id) & (whole.set_key == classes.set_key), "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "set_key", "a", "b", "sketch"),
        "classes",
    )
    light = reps.select("id", "n", "sketch")
    keys = common.written(_table_keys(reps), "tables")
    sets = common.written(
        given.withColumnRenamed("doc_id", "id").join(keys.select("id").distinct().join(reps.select("id", "set_key"), "id"), "id").select("id", "text", "set_key").transform(common.mapped, _sets(k), "id long, shingles array<long>"),
        "sets",
    )

    common.collected(docs.sparkSession)

    # Every table's members against its smallest one.
    ends = keys.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("hi")).where("u < hi").select("key", "u")
    first = common.written(_likely_pairs(keys.join(ends, "key").select("u", F.col("id").alias("v")).where("u < v").distinct(), light, threshold), "pairs")
    linked = common.written(_verified(first, sets, threshold), "links")
    roots = components(linked)
    common.collected(docs.sparkSession)

    # Members of tables with several roots against pivots of other roots.
    rooted = keys.join(roots, keys.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    left = _refined(rooted.join(light, "id"), table_rows)
    found = left.join(_pivots(left, pivots), "key").where((F.col("root") != F.col("root_")) & _likely(threshold)).select(F.least("id", "id_").alias("u"), F.greatest("id", "id_").alias("v")).distinct()
    rest = common.written(found.join(first, ["u", "v"], "left_anti"), "pairs")
    more = common.written(_verified(rest, sets, threshold), "links")
    roots = _merged(roots, more)
    common.collected(docs.sparkSession)

    # Every table that is not settled by now, exactly.
    active = sets.select("id", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("shared"))
    open_ = common.written(_unsettled_rows(keys, roots), "unsettled_rows")
    pairs = ngram_join.unsettled(_groups(open_), roots, active, threshold).join(first.unionByName(rest), ["u", "v"], "left_anti")
    unsettled = common.written(pairs, "unsettled")
    common.collected(docs.sparkSession)
    last = common.written(ngram_join.verified(unsettled, active, threshold), "links")
    common.deleted(first, rest, left, sets, keys, linked, more, open_)
    roots = _merged(roots, last)
    common.collected(docs.sparkSession)

    member = feats.where("set_key is not null").join(classes, "set_key", "left").unionByName(feats.where("set_key is null").withColumn("id", F.lit(None).cast("long")))
    member = member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id"))
    out = member.join(roots, member.id == roots.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots once further links are known."""
    if links.isEmpty():
        return roots
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("u", "v")]
    joint = links.join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    above = components(joint).select(F.col("node").alias("low"), F.col("root").alias("top"))
    nodes = roots.unionByName(joint.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    return common.written(nodes.join(above, F.col("root") == F.col("low"), "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _once(groups: DataFrame) -> DataFrame:
    """The keys of the groups that rows (key, id) make, of groups with the same members one."""
    own = groups.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q"))
    return own.groupBy("m", "p", "q").agg(F.min("key").alias("key")).select("key")


def _unsettled_rows(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (id, key, x) of tables whose members have several roots, of tables with the same members one."""
    rooted = keys.join(roots, keys.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    tables = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = keys.join(tables, "key", "left_semi")
    return rows.join(_once(rows), "key", "left_semi")


def _groups(rows: DataFrame) -> DataFrame:
    """Groups (id, key) that hold every pair of members of the tables in rows (id, key, x), with fewer rows than these.

    A document has up to bands tables for one of its first bands (x), and near copies meet in most of them. The members of
    a first band's tables are one group if that makes at most four times as many pairs as the tables, and stay in their tables if not.
    """
    square = lambda c: F.col(c).cast("double") * F.col(c)
    tables = rows.groupBy("x", "key").agg(F.count("*").alias("m")).groupBy("x").agg(F.sum(square("m")).alias("apart"))
    members = rows.select("x", "id").distinct()
    merged = members.groupBy("x").agg(F.count("*").alias("m")).join(tables, "x").where(square("m") <= 4 * F.col("apart")).select("x")
    wide = members.join(merged, "x", "left_semi").select("id", F.col("x").alias("key"))
    return wide.join(_once(wide), "key", "left_semi").select("id", "key").unionByName(rows.join(merged, "x", "left_anti").select("id", "key"))


def _likely_pairs(pairs: DataFrame, light: DataFrame, threshold: int) -> DataFrame:
    one = light.select(F.col("id").alias("u"), "n", "sketch")
    two = light.select(F.col("id").alias("v"), F.col("n").alias("n_"), F.col("sketch").alias("sketch_"))
    return pairs.join(two, "v").join(one, "u").where(_likely(threshold)).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    one = sets.select(F.col("id").alias("u"), F.col("shingles").alias("s"))
    two = sets.select(F.col("id").alias("v"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(one, "u").join(two, "v").where(100 * both >= threshold * (F.size("s") + F.size("t") - both)).select("u", "v").distinct()


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, columns unchanged: one row of each component, and rows that cannot be linked.

    The choice is made by row: of repeated rows one stays, rows without doc_id are compared like others, and two texts
    under one doc_id are two documents. Where ids do not name the rows, a numbered copy of the documents is written.
    """
    ids = docs.agg(F.count("*").alias("all"), F.count_distinct("doc_id").alias("different")).first()
    if ids["all"] == ids["different"]:
        gone = near_duplicates(docs, **options).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    row = common.free_name(docs, "row")
    rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **options).where(~F.col("kept")).select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
