"""Exact top-k search in Hamming space by incremental multi-index hashing.

A binary code is cut into segments of 16 bits, or of 21 and 22 for large tables, each indexed by its value, so that a value
has few rows. For a query, the tables are probed with all
segment values within a radius of 0, then 1, and so on. A code that differs from the query in at most
segments * (radius + 1) - 1 bits must differ by `radius` or less in some segment, so it has been found by
then; a query is finished once its kth verified distance is within that bound, and only unfinished queries
go on to the next radius. The probes of one radius are all bit masks of that weight, a table of fixed size. A code is a
candidate at the first radius and segment that meet it, and only while it is no farther than k rows found before, both
decided where probes and index meet.

Equal codes are one index entry with its k smallest ids, so copies cost no pairs, and a code shared by a
third of all rows is one row. Candidates are verified on the whole code; each round keeps, for a query code, the
codes needed to cover k rows. Neighbours are ordered by distance, then id; the query's own row counts.

Defined cases: null codes are neither found nor searched with; rows with null ids are not found; repeated
rows count as often as they occur; fewer than k rows in all yield as many neighbours; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 64


def sign_code(vector: str, bits: int = BITS) -> Column:
    """A long whose bit i is set where component i is positive; missing and null components count as not."""
    bit = [F.when(F.get(F.col(vector), i) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    out = bit[0]
    for b in bit[1:]:
        out = out.bitwiseOR(b)
    return F.when(F.col(vector).isNotNull(), out)


def widths_for(codes: int) -> list[int]:
    """Bits of the segments for so many different codes: 16, and 21 or 22 once log2 of their number is nearer to that.

    Narrower segments for small tables were measured: as each step to wider ones adds a radius, probes grew from 776,508 to
    9,927,520 rows for five times the codes, with no less CPU time than 16 bits take.
    """
    m = min(4, max(3, round(BITS / log2(max(codes, 2)))))
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _segments(code: Column, widths: list[int]) -> Column:
    return F.array(*(F.shiftrightunsigned(code, sum(widths[:i])).bitwiseAND(F.lit((1 << w) - 1)) for i, w in enumerate(widths)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _first_met(radius: int, widths: list[int]) -> Column:
    """Whether no smaller radius and no segment before this one (at) meets the code: each is a candidate once, without a
    grouping of pairs or a join with those of earlier radii."""
    differ, once, at = F.col("q").bitwiseXOR(F.col("code")), F.lit(True), 0
    for i, w in enumerate(widths):
        mask = ((1 << w) - 1) << at
        near = F.bit_count(differ.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        once = once & ((near > radius) | ((near == radius) & (F.col("at") <= i)))
        at += w
    return once


def search(rows: DataFrame, queries: DataFrame, k: int = 10, widths: list[int] | None = None) -> DataFrame:
    """query_id, neighbor_id, distance and rank (1 to k) of the k nearest rows (id, code) of each query (id, code).

    widths: bits of the segments, BITS in all; they follow from the number of codes if not given.
    """
    spark = rows.sparkSession
    known = rows.where(F.col("code").isNotNull() & F.col("id").isNotNull())
    per_code = Window.partitionBy("code").orderBy("id")
    listed = known.withColumn("r", F.row_number().over(per_code)).where(F.col("r") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    codes = common.settle(listed)
    asked = queries.where(F.col("code").isNotNull()).select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    total, different = codes.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    want, widths = min(k, total), widths or widths_for(different)
    segments = len(widths)
    index = codes.select("code", F.size("ids").alias("n"), F.posexplode(_segments(F.col("code"), widths)).alias("segment", "value"))
    open_ = common.settle(asked.select("q").distinct().withColumn("most", F.lit(BITS)))
    found = spark.createDataFrame([], "q long, code long, distance int, n int")
    done = found
    for radius in range(max(widths) + 1):
        if want == 0 or open_.isEmpty():
            break
        masks = spark.createDataFrame([(i, sum(1 << b for b in bits)) for i, w in enumerate(widths) for bits in combinations(range(w), radius)], "segment int, mask long")
        probes = open_.select("q", "most", F.posexplode(_segments(F.col("q"), widths)).alias("segment", "own"))
        # Codes are bits alone, so the masks of a radius are a fixed table: C(22, radius) a segment at most.
        probes = probes.join(F.broadcast(masks), "segment").select("q", "most", F.col("segment").alias("at"), F.col("own").bitwiseXOR(F.col("mask")).alias("wanted"))
        met = (F.col("segment") == F.col("at")) & (F.col("value") == F.col("wanted")) & _first_met(radius, widths) & (_distance("q", "code") <= F.col("most"))
        fresh = probes.join(index, met).select("q", "code", _distance("q", "code").alias("distance"), "n")
        near = Window.partitionBy("q").orderBy("distance")
        seen = found.unionByName(fresh).withColumn("before", F.coalesce(F.sum("n").over(near.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # Codes farther than k rows that are nearer cannot be among the k nearest.
        found = common.settle(seen.where(F.col("before") < k).drop("before"))
        proven = segments * (radius + 1) - 1
        enough = F.sum("n") >= want
        state = found.groupBy("q").agg(F.when(enough, F.max("distance")).otherwise(BITS).alias("most"), F.coalesce(F.sum(F.when(F.col("distance") <= proven, F.col("n"))) >= want, F.lit(False)).alias("finished"))
        state = common.settle(state)
        done = done.unionByName(found.join(state.where("finished"), "q", "left_semi"))
        open_ = common.settle(open_.select("q").join(state, "q", "left").where(~F.coalesce("finished", F.lit(False))).select("q", F.coalesce("most", F.lit(BITS)).alias("most")))
        found = common.settle(found.join(state.where("finished"), "q", "left_anti").select("q", "code", "distance", "n"))
    members = done.join(codes, "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    best = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.join(best, "q").select("query_id", "neighbor_id", "distance", "rank")
