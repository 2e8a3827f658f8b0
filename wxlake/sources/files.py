"""Files of bulletins as DataFrames: bare texts, framed byte streams, and XML stanzas.

    inputs(spark, root)   one row a file: path (relative), content, hint
    messages(files)       one row a message, or one row with the error that rejects the whole file

A file's kind follows from its hint, else from its bytes: a stanza, then frames, then a bare bulletin. One bad frame
rejects its file; per_frame=True rejects that frame alone, as the timeline report does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, spread
from . import ranges
from .ranges import MOST_FRAME_BYTES
from .stanza import stanza

#: Parts that a stream's messages are dealt over where they meet what is said of the stream.
SALTS = 32
SKIPPED = (".git", "target", "__pycache__")
FRAMED_ENDINGS = ("sbn", "pid201", "bin", "dat", "ldm")
SOH = b"\x01"
_FRAME = re.compile(rb"\x01[^\x03]*\x03")


def _root(spark: SparkSession, path: str) -> str:
    """The folder that paths are relative to: `records` inside the given one where it exists."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isFile():
        return at.getParent().toString()
    inner = jvm.org.apache.hadoop.fs.Path(at, "records")
    return (inner if fs.exists(inner) and fs.getFileStatus(inner).isDirectory() else at).toString()


def hint_of(path: Column) -> Column:
    """xml, framed or auto, by the file's ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending == "xml", "xml").when(ending.isin(*FRAMED_ENDINGS), "framed").otherwise("auto")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-z]+:/*", "/")


def plain_path(uri: str) -> str:
    """A file's path from the form that _metadata has."""
    return unquote(re.sub("^[a-z]+:/*", "/", uri))


def _below(path: Column, root: str) -> Column:
    """A path relative to a folder."""
    base = _plain(F.lit(root)) if ":" in root else F.lit(root)
    return F.regexp_replace(F.substring(_plain(path), F.length(base) + 1, F.lit(1 << 20)), "^/+", "")


def _skipped(relative: Column) -> Column:
    return F.arrays_overlap(F.split(relative, "/"), F.array(*map(F.lit, SKIPPED)))


def inputs(spark: SparkSession, path: str, hint: str | None = None, wanted: Column | None = None) -> DataFrame:
    """Every file below a path but those in skipped folders. Spark's own listing leaves out empty files and names that
    begin with `_` or `.`."""
    root = _root(spark, path)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path if _is_file(spark, path) else root)
    relative = _below(F.col("path"), root)
    read = read.where(~_skipped(relative)) if wanted is None else read.where(wanted).where(~_skipped(relative))
    return read.select(relative.alias("path"), "content", F.coalesce(F.lit(hint), hint_of(F.col("path"))).alias("hint"))


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def text_of(content: Column) -> Column:
    """UTF-8 text, null if the bytes are none."""
    return F.try_validate_utf8(content.cast("string"))


def looks_like_stanza(content: Column) -> Column:
    text = F.regexp_replace(text_of(content), r"^[ \t\n\r\f]+", "")
    named = text.contains("xmlns='nwws-oi'") | text.contains('xmlns="nwws-oi"') | text.startswith("<message")
    return F.coalesce(text.startswith("<") & named, F.lit(False))


def looks_like_frames(content: Column) -> Column:
    """The first start byte comes before the first end byte, or begins the content."""
    wide = F.decode(content, "ISO-8859-1")
    start, end = F.instr(wide, "\x01"), F.instr(wide, "\x03")
    return F.when((start > 0) & (end > 0), start < end).otherwise(start == 1)


_CHUNK = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bytes", T.BinaryType())])
FRAMES = T.StructType([T.StructField("chunks", T.ArrayType(_CHUNK)), T.StructField("junk", T.LongType()), T.StructField("pending", T.LongType())])


def framed(content: bytes | None) -> dict:
    """Frames from a start byte to the next end byte with their byte ranges; the junk before the first; and what follows
    the last one. Without a frame, what precedes a start byte is junk, and all of it if there is none."""
    content = content or b""
    chunks = [{"start": m.start(), "end": m.end(), "bytes": m[0]} for m in _FRAME.finditer(content)]
    first = content.find(SOH)
    junk = chunks[0]["start"] if chunks else first if first >= 0 else len(content)
    return {"chunks": chunks, "junk": junk, "pending": len(content) - (chunks[-1]["end"] if chunks else junk)}


@F.pandas_udf(FRAMES)
def _frames(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for contents in batches:
        yield pd.DataFrame([framed(c) for c in contents], columns=FRAMES.names)


#: As for parsed bulletins, filters must not make the call run again.
frames = _frames.asNondeterministic()


def with_kind(files: DataFrame) -> DataFrame:
    """Add input_kind and transport."""
    auto = F.col("hint").isin("auto", "stream")
    kind = (
        F.when((F.col("hint") == "xml") | (auto & looks_like_stanza(F.col("content"))), "xml_stanza")
        .when((F.col("hint") == "framed") | (auto & looks_like_frames(F.col("content"))), "framed_stream")
        .otherwise("bulletin")
    )
    out = files.withColumn("input_kind", kind)
    framed = F.when(F.col("hint") == "stream", "plain_text").otherwise("pid201")
    return out.withColumn("transport", F.when(F.col("input_kind") == "xml_stanza", "open_interface").when(F.col("input_kind") == "framed_stream", framed).otherwise("plain_text"))


WRAPPER = "struct<type:string,sender:string,recipient:string,summary:string,xhtml_summary:string,cccc:string,ttaaii:string,awips:string,process_id:string,sequence:decimal(20,0)>"
_SHAPE = ["path", "input_kind", "transport", "message_index", "byte_start", "byte_end", "raw", "wrapper_id", "wrapper_issue", "wrapper", "input_error"]


def messages(files: DataFrame) -> DataFrame:
    """Messages of files: raw is the text to parse; input_error says why a file has none."""
    known = with_kind(files)
    none = lambda kind: F.lit(None).cast(kind)
    wrapper = WRAPPER
    bare = known.where(F.col("input_kind") == "bulletin").select("path", "input_kind", "transport", F.lit(1).alias("message_index"), none("long").alias("byte_start"), none("long").alias("byte_end"), text_of(F.col("content")).alias("raw"), none("string").alias("wrapper_id"), none("timestamp").alias("wrapper_issue"), none(wrapper).alias("wrapper"), none("string").alias("input_error"))
    framed = known.where(F.col("input_kind") == "framed_stream").withColumn("f", frames(F.col("content")))
    over = F.exists("f.chunks", lambda c: c["end"] - c["start"] > MOST_FRAME_BYTES) | (F.col("f.pending") > MOST_FRAME_BYTES)
    error = F.when(over, "Oversized").when(F.size("f.chunks") == 0, "no framed messages detected in stream")
    framed = framed.select("path", "input_kind", "transport", error.alias("input_error"), F.posexplode_outer(F.when(error.isNull(), F.col("f.chunks"))).alias("at", "c"))
    framed = framed.select("path", "input_kind", "transport", F.coalesce(F.col("at") + 1, F.lit(1)).alias("message_index"), F.col("c.start").alias("byte_start"), F.col("c.end").alias("byte_end"), text_of(F.col("c.bytes")).alias("raw"), none("string").alias("wrapper_id"), none("timestamp").alias("wrapper_issue"), none(wrapper).alias("wrapper"), "input_error")
    framed = spread(framed)  # a long stream's frames are in one task until here
    xml = known.where(F.col("input_kind") == "xml_stanza").withColumn("s", stanza(text_of(F.col("content"))))
    p = F.col("s.payload")
    meta = F.struct("s.type", "s.sender", "s.recipient", "s.summary", "s.xhtml_summary", p["cccc"].alias("cccc"), p["ttaaii"].alias("ttaaii"), p["awips"].alias("awips"), p["process_id"].alias("process_id"), p["sequence"].cast("decimal(20,0)").alias("sequence"))
    failed = F.coalesce("s.error", F.when(p.isNull(), "MissingField: nwws-oi payload"))
    xml = xml.select("path", "input_kind", "transport", F.lit(1).alias("message_index"), none("long").alias("byte_start"), none("long").alias("byte_end"), p["raw"].alias("raw"), p["id"].alias("wrapper_id"), p["issue"].alias("wrapper_issue"), meta.cast(wrapper).alias("wrapper"), failed.alias("input_error"))
    return bare.unionByName(framed).unionByName(xml).select(*_SHAPE)


def messages_at(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """Messages of the files below a path. Files that are framed by their hint or ending are read in byte ranges, so a stream of
    any size is many tasks' work; the others are read whole."""
    if hint not in (None, "framed"):
        return messages(inputs(spark, path, hint))
    framed = F.lit(True) if hint else hint_of(F.col("_metadata.file_path")) == "framed"
    root = _root(spark, path)
    found = ranges.frames(spark, path if _is_file(spark, path) else root, framed)
    relative = _below(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root)
    none = lambda kind: F.lit(None).cast(kind)
    rows = found.withColumn("path", relative).where(~_skipped(F.col("path"))).select(
        "path", F.lit("framed_stream").alias("input_kind"), F.lit("pid201").alias("transport"), "message_index", "byte_start", "byte_end", text_of(F.col("raw")).alias("raw"),
        none("string").alias("wrapper_id"), none("timestamp").alias("wrapper_issue"), none(WRAPPER).alias("wrapper"), F.col("error").alias("input_error"),
    )
    return rows if hint else messages(inputs(spark, path, None, ~framed)).unionByName(rows)


def inspected(rows: DataFrame, per_frame: bool = False, columns: tuple[str, ...] | None = None, parts: tuple[str, ...] | None = None) -> DataFrame:
    """Parse messages() and apply the rules of their wrappers and files. columns and parts name what is needed of the parsed bulletins, as in
    bulletins.products(); with columns named, texts and wrappers are left out.

    A stanza's station and type must equal the heading's, while its identifier may differ. Unless per_frame, one bad
    frame rejects all messages of its file.
    """
    from ..operators import reports

    out = reports.parsed(rows, columns and tuple({*columns, "ttaaii", "cccc", "error_kind", "error_field"}), parts)
    clash = F.when(F.col("wrapper.ttaaii") != F.col("ttaaii"), "ttaaii").when(F.col("wrapper.cccc") != F.col("cccc"), "cccc")
    found = F.when(F.col("input_error").isNotNull(), F.struct(F.lit("Input").alias("kind"), F.col("input_error").alias("field"))).when(F.col("error_kind").isNull() & clash.isNotNull(), F.struct(F.lit("Mismatch").alias("kind"), clash.alias("field")))
    out = out.withColumn("_found", found)
    out = out.withColumns({"error_kind": F.coalesce("_found.kind", "error_kind"), "error_field": F.coalesce("_found.field", "error_field")}).drop("_found")
    out = out if columns is None else out.drop("raw", "wrapper")
    if per_frame:
        return out
    out = settled(out, "inspected")  # read for the bad frames and for the join
    # A stream's messages are dealt over SALTS parts, so that a long one does not meet its verdict in one task.
    bad = out.where((F.col("input_kind") == "framed_stream") & F.col("error_kind").isNotNull()).select("path").distinct().withColumns({"_bad": F.lit(True), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    out = out.withColumn("_salt", F.pmod("message_index", F.lit(SALTS))).join(bad, ["path", "_salt"], "left").drop("_salt")
    spoilt = F.coalesce("_bad", F.lit(False)) & F.col("error_kind").isNull()
    return out.withColumns({"error_kind": F.when(spoilt, "Rejected").otherwise(F.col("error_kind")), "error_field": F.when(spoilt, "another frame of the file").otherwise(F.col("error_field"))}).drop("_bad")


def split_frames(files: DataFrame) -> DataFrame:
    """One row a file: frames, junk and pending bytes as framed() has them, before any parsing; natively, as no frame is needed. A record that
    an end byte closes is a frame if it has a start byte."""
    wide = F.decode(F.coalesce("content", F.lit(b"")), "ISO-8859-1")  # a byte a character
    rows = files.select("path", F.split(wide, "\x03").alias("r"), F.length(wide).cast("long").alias("long"), F.instr(wide, "\x01").cast("long").alias("at"))
    closed = F.transform(F.slice("r", 1, F.size("r") - 1), lambda x, i: F.when(x.contains("\x01"), i + 1))
    rows = rows.withColumn("ends", F.array_compact(closed))
    junk = F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.col("long"))
    last = F.array_max("ends")
    rest = F.length(F.array_join(F.slice("r", last + 1, F.size("r") - last), "\x03")).cast("long")
    return rows.select("path", F.size("ends").alias("frames"), junk.alias("junk_bytes"), F.when(F.size("ends") > 0, rest).otherwise(F.col("long") - junk).alias("pending_bytes"))
