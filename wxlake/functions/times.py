"""Times of bulletins as native columns. Timestamps are UTC; the session's time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TIME = "000000T0000Z"
VTEC_TIME = "([0-9]{2})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})Z"


def utc(text: str) -> Column:
    return F.to_timestamp(F.lit(text.replace("T", " ").removesuffix("Z")))


def _made(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.try_make_timestamp(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)"))


def vtec_time(group: Column) -> Column:
    """YYMMDDThhmmZ as a timestamp; null if unspecified or no valid time (tell them apart with vtec_time_ok)."""
    part = [F.try_to_number(F.substring(group, at, 2), F.lit("99")).cast("int") for at in (1, 3, 5, 8, 10)]
    return F.when((group != NO_TIME) & group.rlike(f"^{VTEC_TIME}$"), _made(part[0] + 2000, *part[1:]))


def vtec_time_ok(group: Column) -> Column:
    return (group == NO_TIME) | vtec_time(group).isNotNull()


def vtec_time_text(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyMMdd'T'HHmm'Z'"), F.lit(NO_TIME))


def issue_time(yygggg: Column, anchor: Column) -> Column:
    """DDHHMM in the month before, of or after the anchor: the nearest time, the past one of two; null if none exists."""
    day, hour, minute = (F.substring(yygggg, at, 2).cast("int") for at in (1, 3, 5))
    first = F.trunc(anchor, "MM")
    near = []
    for offset in (-1, 0, 1):
        month = F.add_months(first, offset)
        time = _made(F.year(month), F.month(month), day, hour, minute)
        gap = F.unix_seconds(time) - F.unix_seconds(anchor)
        near.append(F.when(time.isNotNull(), F.struct(F.abs(gap).alias("distance"), (gap > 0).alias("future"), time.alias("time"))))
    return F.when(yygggg.rlike("^[0-9]{6}$") & anchor.isNotNull(), F.array_min(F.array_compact(F.array(*near)))["time"])


def rfc3339(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


def overlap_seconds(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Seconds that two half-open intervals share; null if a bound is."""
    known = start.isNotNull() & end.isNotNull() & other_start.isNotNull() & other_end.isNotNull()
    return F.when(known, F.greatest(F.lit(0), seconds(F.greatest(start, other_start), F.least(end, other_end))))


def contains(start: Column, end: Column, time: Column) -> Column:
    """Whether [start, end) holds the time; a null bound is open."""
    return F.coalesce(time >= start, F.lit(True)) & F.coalesce(time < end, F.lit(True))
