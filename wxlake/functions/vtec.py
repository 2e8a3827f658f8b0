"""Event codes as native columns: an anchored pattern, closed code sets, and calendar checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes, times

_ASCII_SPACE = " \t\n\r\f"
_TIME = "[0-9]{6}T[0-9]{4}Z"


def _any(values) -> str:
    return "|".join(values)


#: Fields of /k.aaa.cccc.pp.s.####.start-end/ and /nwsli.s.ic.begin.crest.end.fr/.
P_VTEC = rf"^/({_any(codes.EVENT_CLASSES)})\.({_any(codes.ACTIONS)})\.([A-Z]{{4}})\.({_any(codes.PHENOMENA)})\.({_any(codes.SIGNIFICANCES)})\.([0-9]{{4}})\.({_TIME})-({_TIME})/$"
H_VTEC = rf"^/([A-Z0-9]{{5}})\.({_any(codes.FLOOD_SEVERITIES)})\.({_any(codes.FLOOD_CAUSES)})\.({_TIME})\.({_TIME})\.({_TIME})\.({_any(codes.FLOOD_RECORDS)})/$"


#: Lines that look like a heading and like an identifier.
HEADING = r"^[A-Z]{4}[0-9]{2}\s+[A-Z]{4}\s+[0-9]{6}(?:\s+[A-Z0-9]{3})?$"
IDENTIFIER = r"^[A-Z0-9]{5,6}$"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_ASCII_SPACE))


def is_p_vtec(line: Column) -> Column:
    raw = trimmed(line)
    part = lambda i: F.regexp_extract(raw, P_VTEC, i)
    return raw.rlike(P_VTEC) & times.vtec_time_ok(part(7)) & times.vtec_time_ok(part(8))


def is_h_vtec(line: Column) -> Column:
    raw = trimmed(line)
    part = lambda i: F.regexp_extract(raw, H_VTEC, i)
    return raw.rlike(H_VTEC) & times.vtec_time_ok(part(4)) & times.vtec_time_ok(part(5)) & times.vtec_time_ok(part(6))


def p_vtec(line: Column) -> Column:
    """The code as a struct, null if it is none."""
    raw = trimmed(line)
    part = lambda i: F.regexp_extract(raw, P_VTEC, i)
    fields = F.struct(
        raw.alias("raw"),
        part(1).alias("event_class"),
        part(2).alias("action"),
        part(3).alias("office"),
        part(4).alias("phenomenon"),
        part(5).alias("significance"),
        part(6).cast("int").alias("etn"),
        times.vtec_time(part(7)).alias("valid_start"),
        (part(7) == times.NO_TIME).alias("start_unspecified"),
        times.vtec_time(part(8)).alias("valid_end"),
        (part(8) == times.NO_TIME).alias("end_unspecified"),
    )
    return F.when(is_p_vtec(line), fields)


def h_vtec(line: Column) -> Column:
    raw = trimmed(line)
    part = lambda i: F.regexp_extract(raw, H_VTEC, i)
    fields = F.struct(raw.alias("raw"), part(1).alias("nwsli"), part(2).alias("severity"), part(3).alias("cause"), times.vtec_time(part(4)).alias("begin"), times.vtec_time(part(5)).alias("crest"), times.vtec_time(part(6)).alias("end"), part(7).alias("record"))
    return F.when(is_h_vtec(line), fields)


def hydrologic_pair(primary: Column, hydrologic: Column) -> Column:
    """Both codes as a struct; null unless both are valid and the phenomenon takes a hydrologic code."""
    p = p_vtec(primary)
    return F.when(p["phenomenon"].isin(*codes.HYDROLOGIC) & is_h_vtec(hydrologic), F.struct(p.alias("primary"), h_vtec(hydrologic).alias("hydrologic")))


def event_id(v: Column) -> Column:
    """office.class.phenomenon.significance.number of a P-VTEC struct."""
    return F.concat_ws(".", v["office"], v["event_class"], v["phenomenon"], v["significance"], F.lpad(v["etn"].cast("string"), 4, "0"))
