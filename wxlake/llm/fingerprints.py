"""Bottom-k fingerprints of documents, in DataFrame functions only.

A fingerprint is the k smallest hashes of a text's distinct word shingles, ascending. The fingerprint of a
union of parts is the k smallest of both parts' hashes (`merged`), so partial fingerprints of any split
combine without the texts. Two fingerprints estimate resemblance from the share of the k smallest hashes
of their union that both hold, a fingerprint alone the number of distinct shingles, and both together
containment. Sets of at most k shingles are held whole, and their estimates are exact.

Words are what stands between ASCII white space, A-Z lower-cased; a text with fewer words than a shingle
takes is one shingle; a text without words has the empty fingerprint and resembles only its like.

Defined cases: a null text is empty; rows with equal ids are ordered by text; a null id comes last; repeated
rows each yield a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hashes lie in [0, 2**62).
RANGE = 1 << 62


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """Sorted distinct shingle hashes of a text column."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.transform(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - words + 1, F.lit(1)))
        whole = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(t, i, words)), 2))
        return F.when(F.size(t) == 0, F.array().cast("array<long>")).otherwise(whole)

    # Binds the token array once, so that each shingle does not split the text anew.
    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.array(tokens), shingles))))


def fingerprint(text: Column, k: int = 128, words: int = 5) -> Column:
    return F.slice(shingle_hashes(text, words), 1, k)


def merged(a: Column, b: Column, k: int = 128) -> Column:
    """The fingerprint of the union of what two fingerprints stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(fingerprints: DataFrame, key: str, column: str = "fingerprint", k: int = 128) -> DataFrame:
    """One fingerprint a key from those of its parts. Each key holds k hashes at most after a partial step by
    part, so that a key with most of the rows does not meet in one task."""
    from pyspark.sql import Window

    hashes = fingerprints.select(key, F.explode(column).alias("h")).distinct()
    ranked = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard likeness of two fingerprints."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(RANGE) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b holds too."""
    union, like = distinct_shingles(merged(a, b, k), k), resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), like * union / distinct_shingles(a, k)))


def shown(a: Column) -> Column:
    """A fingerprint as text: hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


#: Ranges of ids at most; their bounds and first documents are small tables.
MOST_RANGES = 100_000


def _bucketed(docs: DataFrame, rows: int) -> DataFrame:
    """Documents with a bucket of neighbouring ids, numbered from 0 for the highest ids; a bucket holds about `rows`, or a
    MOST_RANGES-th of all documents if that is more."""
    n = docs.count()
    parts = min(MOST_RANGES, max(1, n // rows))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0] or [])) if shares else []
    # How many of the ascending cuts lie at or below the id, by a binary search over one literal array.
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")

    def halved(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = F.get(table, mid) <= F.col("doc_id")
        open_ = span["lo"] < span["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(span["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(span["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    below = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halved)["lo"]
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below))


def edited_pairs(docs: DataFrame, k: int = 128, words: int = 5, rows: int = 4000) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's, in descending order of doc_id.

    The edited text ends in the beginning of the next document's instead of its own last third. Neighbours
    meet by one shuffle on ranges of ids; only the first row of each range crosses to the one before it.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = _bucketed(base, rows)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    # The first document of each range: its id first, from the ids alone, then its text. MOST_RANGES rows at most.
    tops = common.settle(ranged.groupBy("bucket").agg(F.max("doc_id").alias("top")))
    starts = base.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("head"))
    across = Window.orderBy("bucket")
    ring = common.settle(starts)
    first = ring.select(F.min("bucket")).first()[0]
    nxt = ring.select("bucket", F.lead("bucket").over(across).alias("to")).select("bucket", F.coalesce("to", F.lit(first)).alias("to"))
    beyond = nxt.join(ring.select(F.col("bucket").alias("to"), "head"), "to").select("bucket", "head")
    w = Window.partitionBy("bucket").orderBy(*order)
    # Only texts are shuffled, once; fingerprints are made behind the exchange, which the window and the join with
    # the next ranges' heads both use.
    near = ranged.repartition("bucket").withColumn("fp", fingerprint(F.col("text"), k, words))
    near = near.select("bucket", "doc_id", "text", "fp", F.lead("text").over(w).alias("follows"), F.lead("fp").over(w).alias("follows_fp"))
    beyond = beyond.select("bucket", "head", fingerprint(F.col("head"), k, words).alias("head_fp"))
    both = near.join(beyond, "bucket").select("doc_id", "text", "fp", F.coalesce("follows", "head").alias("next"), F.coalesce("follows_fp", "head_fp").alias("next_fp"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring(F.col("next"), F.lit(1), third))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    out = out.withColumn("edited_fp", fingerprint(F.col("edited"), k, words))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        distinct_shingles(F.col("fp"), k).alias("shingles"),
        containment(F.col("edited_fp"), F.col("fp"), k).alias("edited_in_text"),
    )
