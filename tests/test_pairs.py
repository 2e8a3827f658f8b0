"""Pairs of warnings: each once, whatever the sizes of their boxes and intervals, by a join that compares few numbers for two rows of a cell."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wxlake.functions import geometry
from wxlake.operators import reports

POLYGON = "array<struct<lat float, lon float>>"


def _records(n: int) -> list[tuple]:
    r, at = random.Random(5), datetime(2024, 1, 10)
    rows = []
    for i in range(n):
        y, x = r.uniform(30, 34), r.uniform(-90, -86)
        size = r.choice((0.1, 0.4, 1.5, 3.0))
        ring = [(y, x), (y, x + size), (y + size, x + size), (y + size, x)]
        start = at + timedelta(minutes=r.randrange(600))
        end = start + timedelta(minutes=r.choice((20, 55, 100, 400, -5)))
        rows.append((f"{r.randrange(1000):04}-{i}", f"e{i % 40}", start, end, ring[:3] if i % 9 == 0 else ring))
    return rows


def test_pairs_of_all_sizes_come_once(spark):
    rows = _records(150)
    df = spark.createDataFrame(rows, f"record_key string, event_id string, valid_start timestamp, valid_end timestamp, polygon {POLYGON}").withColumn("note", F.lit("text"))
    df = df.withColumns({c: F.lit(None).cast("timestamp") for c in ("issued_at", "wrapper_issue", "expires_at", "canceled_at")}).repartition(3)
    pairs = reports.overlapping_pairs(df, reports.MEASURED)
    assert set(pairs.schema["left"].dataType.names) == {*reports.MEASURED, "shape"}  # not the note, nor the polygon
    for condition in re.findall("Inner, (.*)", pairs._jdf.queryExecution().executedPlan().toString()):
        assert "event_id" not in condition and "record_key" not in condition and "POWER" not in condition
    box = lambda p: (min(y for y, _ in p), max(y for y, _ in p), min(x for _, x in p), max(x for _, x in p))
    meet = lambda a, b: a[2] < b[3] and b[2] < a[3] and (p := box(a[4]))[0] <= (q := box(b[4]))[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]
    real = [r for r in rows if r[3] > r[2]]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(real) for b in real[i + 1 :] if a[1] != b[1] and meet(a, b))
    got = reports.pair_metrics(pairs).select("left_record_key", "right_record_key", "polygon_overlap_area_square_degrees").collect()
    assert sorted((r[0], r[1]) for r in got) == want and len(want) > 300
    whole = reports.overlapping_pairs(df)
    assert whole.where("left.note = 'text' and right.note = 'text'").count() == len(want)


def test_boxes_are_told_as_all_rings_are(spark):
    rings = [[(30.0, -90.0), (30.0, -89.0), (31.0, -89.0), (31.0, -90.0)], [(31.0, -90.0), (30.0, -90.0), (30.0, -89.0), (31.0, -89.0), (31.0, -90.0)], [(0.0, 0.0), (0.0, 2e-5), (2e-5, 2e-5), (2e-5, 0.0)], [(0.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)], None]
    df = spark.createDataFrame([(r,) for r in rings], f"p {POLYGON}").coalesce(1)
    ring = geometry.ring(F.col("p"))
    got = df.select(geometry.shape(F.col("p")).alias("s"), geometry.crosses_itself(ring).alias("crosses"), geometry.is_convex(ring).alias("convex")).collect()
    assert [(r.s.crosses, r.s.convex) for r in got[:4]] == [(r.crosses, r.convex) for r in got[:4]] == [(False, True), (False, True), (False, False), (True, False)]
    assert got[5].s is None
