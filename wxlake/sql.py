"""The parsers as SQL functions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .functions import segmenter
from .functions.geotext import longitude_of
from .functions.times import NO_TIME


@F.arrow_udf(T.ArrayType(T.StringType()))
def ugc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Codes of a geography string, ranges written out; null if it breaks a rule."""
    for texts in batches:
        yield pa.array([None if t is None else segmenter.areas("".join(t.split())) for t in texts.to_pylist()], pa.list_(pa.string()))


PVTEC = T.StructType([*(f for f in segmenter.P_CODE if f.name not in ("start", "end")), T.StructField("valid_start", T.TimestampType()), T.StructField("valid_end", T.TimestampType())])


def moment(time: str) -> datetime | None:
    """YYMMDDThhmmZ; null if unspecified."""
    return None if time == NO_TIME else datetime.strptime("20" + time, "%Y%m%dT%H%MZ").replace(tzinfo=UTC)


@F.arrow_udf(PVTEC)
def pvtec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """An event code with its times; null if it is none."""
    kind = to_arrow_type(PVTEC)
    for texts in batches:
        rows = []
        for t in texts.to_pylist():
            found = segmenter.coded([t])[0] if t else []
            rows.append({**found[0], **{f"valid_{c}": moment(found[0][c]) for c in ("start", "end")}} if found else None)
        yield pa.array(rows, kind)


_CODE = "struct<raw: string, action: string, office: string, phenomenon: string, significance: string, etn: int>"


@F.udtf(returnType=f"segment_index: int, ugc: string, ugcs: array<string>, headline: string, codes: array<{_CODE}>, polygon: array<struct<lat: float, lon: float>>, body: string")
class Segments:
    """Segments of a bulletin, one row each; none if its text is rejected or null."""

    def eval(self, text: str) -> Iterator[tuple]:
        found = segmenter.parse(text)
        for i, s in enumerate(found["parts"] or []):
            codes = [tuple(c[n] for n in ("raw", "action", "office", "phenomenon", "significance", "etn")) for c in s["pvtec"]]
            points = [(p["lat"] / 100, longitude_of(p["lon"], found["cccc"]) / 100) for p in s["lat_lon"]["points"]] if s["lat_lon"] else None
            yield i + 1, s["ugc"], s["ugcs"], s["headline"], codes, points, "\n".join(s["lines"])


FUNCTIONS = {"parse_bulletin": segmenter.parsed, "parse_ugc": ugc, "parse_pvtec": pvtec}


def register(spark: SparkSession) -> None:
    """Make parse_bulletin(text), parse_ugc(text), parse_pvtec(text) and the table function parse_segments(text), for lateral joins,
    known to spark.sql."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("parse_segments", Segments)


def unregister(spark: SparkSession) -> None:
    for name in (*FUNCTIONS, "parse_segments"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
