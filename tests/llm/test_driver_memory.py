"""What many short steps leave on the driver: one table in place of a plan of many, and garbage that is collected on the way."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wxlake.llm import common, neardup


def test_split_tables_are_read_as_one(spark):
    r = random.Random(5)
    rows = [(i % 2, i, i, 10, [r.getrandbits(62) & ~((1 << 18) - 1) for _ in range(neardup.SKETCH_LONGS)]) for i in range(120)]
    given = spark.createDataFrame(rows, "key long, id long, root long, n long, sketch array<long>")
    left = neardup._refined(given, 4)
    assert left._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    # Whatever tables were split, a row's table has members with other roots, and its top is one of them.
    assert left.groupBy("key").agg(F.count_distinct("root").alias("n"), F.max((F.col("root") == F.col("top")).cast("int")).alias("t")).where("n < 2 or t = 0").isEmpty()


def test_garbage_is_collected_between_steps(spark, monkeypatch):
    calls = []
    own = common.collected
    monkeypatch.setattr(common, "collected", lambda s: calls.append(own(s)))
    docs = spark.createDataFrame([(i, " ".join(f"w{j + (i // 2) * 100}" for j in range(30))) for i in range(8)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}
    assert len(calls) >= 4
