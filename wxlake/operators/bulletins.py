"""Raw texts to bulletins, segments and event codes, as DataFrame transformations.

    products(df)    one row a text: heading, identifier, family, body, or the error that rejects it
    segments(df)    one row a segment: geography, codes, lines, polygon, motion, tags
    codes_of(df)    one row an event code
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, segmenter, times

#: Fields of bulletins that their family and their error are told by.
_NEEDED = ("nnn", "mnd_header", "first_code", "error_kind")


def products(df: DataFrame, text: str = "raw", columns: tuple[str, ...] | None = None, parts: tuple[str, ...] | None = None) -> DataFrame:
    """Add the columns of the text's bulletin: heading and its parts, body, parts (segments), family, error.

    columns and parts name the fields of bulletins and segments that are needed, all unless told; parts=() leaves segments out. columns
    may name digests too (segmenter.DIGESTS).
    Errors are data: a rejected text keeps its row with error_kind and error_field, and has no parts. A null text
    counts as bytes that are not UTF-8.
    """
    asked = None if columns is None else tuple(sorted({*columns, *_NEEDED}))
    out = df.withColumn("_s", segmenter.parser(asked, parts)(text))
    known = F.when(F.col("_s.error_kind").isNull(), family(F.col("_s.nnn"), F.col("_s.first_code"), F.col("_s.mnd_header")))
    names = [n for n in segmenter.BULLETIN.names if (n == "parts" and parts != ()) or (n not in ("parts", "first_code") and (columns is None or n in columns))]
    names += [n for n in segmenter.DIGESTS if columns is not None and n in columns]
    return out.select(*df.columns, *(F.col(f"_s.{n}") for n in names), known.alias("family"))


def segments(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row a segment of products(), with the key columns; segment_index is 1-based."""
    rows = parsed.select(*keys, F.posexplode("parts").alias("_at", "_p")).withColumn("segment_index", F.col("_at") + 1)
    names = {"ugc": "ugc_raw", "lines": "body_lines", "dollars": "separated_by_dollars", "ampersands": "contains_andand"}
    found = parsed.schema["parts"].dataType.elementType.names
    return rows.select(*keys, "segment_index", *(F.col(f"_p.{n}").alias(names.get(n, n)) for n in found))


def codes_of(parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row an event code (struct vtec) with its times, and the given columns; vtec_index is 1-based."""
    rows = parts.select(*columns, F.posexplode("pvtec").alias("_at", "vtec"))
    start, end = (times.vtec_time(F.col(f"vtec.{c}")).alias(f"valid_{c}") for c in ("start", "end"))
    return rows.withColumns({"vtec_index": F.col("_at") + 1, "vtec": F.struct("vtec.*", start, end)}).drop("_at")


def family(nnn: Column, first_code: Column, header: Column) -> Column:
    """Product family: by identifier, else by the first event code, else by the title line."""
    title = F.lit("unknown")
    for words, name in reversed(codes.TITLE_FAMILIES.items()):
        title = F.when(F.translate(header, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").contains(words), name).otherwise(title)
    by_code = F.when(first_code["significance"] == "A", "watch").otherwise(F.coalesce(codes.looked_up(first_code["phenomenon"], codes.PHENOMENON_FAMILIES), F.lit("unknown")))
    return F.when(nnn.isNotNull(), codes.product_family(nnn)).when(first_code.isNotNull(), by_code).otherwise(F.coalesce(title, F.lit("unknown")))


def event_family(code: Column, product: Column) -> Column:
    return F.coalesce(codes.looked_up(code["phenomenon"], codes.EVENT_FAMILIES), product)


def issued(yygggg: Column, anchor: Column) -> Column:
    return times.issue_time(yygggg, anchor)
