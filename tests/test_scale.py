"""What keeps work and memory in proportion to the input, and texts that only larger tables have."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wxlake import session
from wxlake.functions import geometry
from wxlake.operators import reports
from wxlake.plans import more_queries, queries, render

POLYGON = "array<struct<lat float, lon float>>"


def test_geometry_computes_its_argument_once(spark):
    rows = spark.range(1).select(F.expr(f"cast(null as {POLYGON})").alias("polygon")).repartition(2)
    mentions = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("polygon#")
    plain = mentions(geometry.ring(F.col("polygon")))
    for f in (geometry.crosses_itself, geometry.is_convex, geometry.signed_area):
        assert mentions(f(geometry.ring(F.col("polygon")))) == plain


def test_boxes_share_what_clipping_says(spark):
    square = lambda y, x, a, b: [(y, x), (y, x + b), (y + a, x + b), (y + a, x)]
    one = square(0, 0, 4, 2)
    cases = [(square(1, 1, 9, 9), 3.0), (square(4, 0, 1, 1), 0.0), (square(7, 7, 1, 1), 0.0), (square(1, 0.5, 1, 1)[::-1], 1.0), ([(0, 0), (0, 2), (4, 0)], 4.0), ([(0, 0), (4, 2), (0, 2), (4, 0)], None)]
    real = lambda ring: [(float(y), float(x)) for y, x in ring]
    df = spark.createDataFrame([(real(one), real(c)) for c, _ in cases], f"a {POLYGON}, b {POLYGON}")
    got = [r.s for r in df.coalesce(1).select(geometry.overlap_area(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [s for _, s in cases]


# --- tables with more users than there are offices


def _users(spark, tmp_path, *ids):
    """Events of users, ten of each, an hour apart."""
    rows = [(100 * k + i + 14, datetime(2024, 1, 10 + k, i), u, "click", 1.0, "") for k, u in enumerate(ids) for i in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_pairs_of_users_that_share_an_office_have_one_corner(spark, tmp_path):
    rows = queries.pair_metrics(spark, _users(spark, tmp_path, 1, 1 + 26**3)).collect()
    assert any("src/000000" in r.left_record_key and "src/0000001" in r.right_record_key for r in rows)
    assert all(r.polygon_overlap_area == min(r.left_area, r.right_area) for r in rows)


def test_every_nineteenth_stanza_names_another_office(spark, tmp_path):
    rows = more_queries.wrapped_messages(spark, _users(spark, tmp_path, 26**3 - 1, 5)).collect()
    number = lambda r: int(r.path[4:13])
    assert {r.error_kind for r in rows if number(r) % 19 == 0 and number(r) % 23 and number(r) % 11} == {"Mismatch"}


# --- rows of reports


def test_warnings_of_a_place_are_not_repeated_for_its_events(spark, monkeypatch):
    kept = {}

    def settled(df, name):
        kept[name] = session.settled(df, name)
        return kept[name]

    monkeypatch.setattr(reports, "settled", settled)
    at = datetime(2024, 1, 10)
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    records = [(f"r{i}", "e", "NEW", at + timedelta(hours=i), at + timedelta(hours=i + 1), ring) for i in range(20)]
    kind = f"record_key string, event_id string, action string, valid_start timestamp, valid_end timestamp, polygon {POLYGON}"
    rows = spark.createDataFrame(records, kind).select("*", F.col("valid_start").alias("issued_at"), *(F.lit(None).cast("timestamp").alias(c) for c in ("wrapper_issue", "expires_at", "canceled_at")))
    events = [(i, at + timedelta(minutes=45 * i), 0.5, 0.5) for i in range(40)] + [(40, None, 0.5, 0.5), (41, at, 5.0, 5.0)]
    got = {r.event: r for r in reports.lead_times(rows, spark.createDataFrame(events, "event long, event_time timestamp, lat double, lon double")).collect()}
    assert kept["hits"].count() == 20
    assert [got[i].event_warning_records for i in (0, 5, 26, 27, 40, 41)] == [1, 1, 1, 0, 0, 0]
    assert (got[5].first_valid_warning_record_key, got[5].lead_time_seconds, got[5].false_alarm_interval_count) == ("r3", 2700, 0)
    assert (got[27].point_warning_records, got[27].false_alarm_interval_count, got[27].false_alarm_duration_seconds) == (20, 1, 72000)
    assert (got[40].point_warning_records, got[40].false_alarm_interval_count, got[41].point_warning_records) == (20, 0, 0)


def test_pairs_come_out_of_their_join_complete(spark, tmp_path):
    rows = reports.records(render.messages(spark, _users(spark, tmp_path, 1, 2, 601)), queries.AT, ("lat_lon",))
    pairs = reports.overlapping_pairs(rows)
    assert pairs._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # no exchange moves pairs


def test_python_workers_get_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    try:
        for given, want in (("10000", "1000"), ("77", "77")):
            spark.conf.set(name, given)
            session.ship(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, held)


def test_texts_of_a_batch_keep_their_order(spark):
    raw = F.concat(F.lit("NOUS41 KAAA 201530\nPNSAAA\n\nTEXT "), F.col("id"), F.lit("\n"))
    rows = reports.parsed(spark.range(0, 950, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("message_index"), raw.alias("raw")))
    assert rows.where(F.substring_index("body", "TEXT ", -1) == F.col("path")).count() == 950
