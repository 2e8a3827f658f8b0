"""The archive: import with deduplication, verification, pruning, routing, and reading back.

Records are rows of a Parquet table partitioned by capture day and family, not one file each, so listing a day is
partition pruning and a table of any size imports by one join. Paths, names and actions are still computed, as
columns, in the form that a directory of files would have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, hashing
from ..session import files_below, moved, remove, settled

#: Days that pruning keeps by default, and the most that one request may look back.
KEEP_DAYS, MOST_DAYS = 30, 92


def sanitized(text: Column, blank: str = "UNKNOWN") -> Column:
    """A path part: every character beyond letters, digits, `.`, `_` and `-` becomes `_`."""
    safe = F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")
    return F.when(F.length(safe) > 0, safe).otherwise(blank)


def tsv_field(text: Column) -> Column:
    return F.regexp_replace(text, "[\t\r\n]", " ")


def split_name(place: Column) -> Column:
    """File name of a message of a framed stream; place counts from 1."""
    awips = sanitized(F.coalesce("awips_id", F.lit("NO-AWIPS")))
    return F.concat(F.lpad(place.cast("string"), 5, "0"), F.lit("_"), F.coalesce("sequence_number", F.lit(0)).cast("string"), F.lit("_"), sanitized(F.col("ttaaii")), F.lit("_"), awips, F.lit(".txt"))


def digested(known: DataFrame) -> DataFrame:
    """Parsed messages with the digests of their text, unless the parser gave them, and their folder; an import needs the text itself
    no further."""
    folder = F.concat_ws("/", F.lit("records"), sanitized(F.col("cccc")), sanitized(F.col("ttaaii")), sanitized(F.coalesce("awips_id", F.lit("NO-AWIPS"))))
    more = {"digest": lambda: hashing.fnv1a(F.col("bulletin")), "text_digest": lambda: F.sha2("bulletin", 256)}
    return known.withColumns({n: c() for n, c in more.items() if n not in known.columns} | {"folder": folder})


def with_digest(known: DataFrame) -> DataFrame:
    """Parsed messages that can be archived, digested."""
    return digested(known.where(F.col("error_kind").isNull()))


#: What the index of an archive holds of each text: where it is, what its bytes are, and the number of its digest's collision.
INDEX = ("folder", "digest", "text_digest", "number")


def _name(digest: Column, number: Column) -> Column:
    return F.concat(digest, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), F.lit(".txt"))


def numbered(known: DataFrame, name: str = "digests") -> DataFrame:
    """Digested messages, written with a number of each row, so that imports which read them need not write them again."""
    return settled(known.withColumn("_row", F.monotonically_increasing_id()), name)


def imported(known: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """What importing parsed messages does to each row: action (archived or duplicate), relative_path, text_digest and number.

    index: INDEX of the texts that are archived already; the texts themselves are not needed. The choice is made on slim
    keys, so of repeated rows one is archived, and each row then meets its text's choice once. Texts that share
    a digest but differ get the suffixes -1, -2 behind those of the archive, in the order of their first message.
    Rows of numbered() are read where they are, others are written first; each number must be of one row.
    """
    rows = known if {"digest", "folder"} <= set(known.columns) else with_digest(known)
    rows = rows if "text_digest" in rows.columns else rows.withColumn("text_digest", F.sha2("bulletin", 256))
    rows = rows if "_row" in rows.columns else numbered(rows)
    text = ["text_digest", "digest", "folder"]  # what differs early comes first, as rows are sorted by it
    place = F.struct(F.split("path", "/").alias("p"), F.col("message_index").alias("m"), F.col("_row").alias("r"))
    slim = rows.select(*text, place.alias("_place"), F.lit(None).cast("int").alias("_old"))
    if index is not None:
        slim = slim.unionByName(index.select(*text, F.lit(None).cast(slim.schema["_place"].dataType).alias("_place"), F.col("number").cast("int").alias("_old")))
    first = slim.groupBy(*text).agg(F.min("_place").alias("_first"), F.min("_old").alias("_old"), F.max("_old").alias("_last"))
    # Texts of one digest: one, but for collisions. Those that the archive has not come first.
    same = Window.partitionBy("digest", "folder")
    fresh = F.row_number().over(same.orderBy(F.col("_old").isNotNull(), "_first")) - 1
    number = fresh if index is None else F.coalesce("_old", F.coalesce(F.max("_last").over(same) + 1, F.lit(0)) + fresh)
    chosen_ = first.withColumn("number", number.cast("int")).where("_first is not null").select(*text, F.when(F.col("_old").isNull(), F.col("_first.r")).alias("keeper"), "number")
    action = F.when(F.col("_row") == F.col("keeper"), "archived").otherwise("duplicate")
    path = F.concat_ws("/", "folder", _name(F.col("digest"), F.col("number")))
    return rows.join(chosen_, text).select(*(c for c in rows.columns if c != "_row"), action.alias("action"), path.alias("relative_path"), "number")


def manifest(done: DataFrame) -> DataFrame:
    """A line for each record that an import archived."""
    new = done.where(F.col("action") == "archived")
    wrapper = F.col("wrapper_id") if "wrapper_id" in done.columns else F.lit(None).cast("string")
    return new.select(
        F.col("digest").alias("fingerprint"),
        "relative_path",
        "input_kind",
        "transport",
        F.col("sequence_number").cast("string").alias("sequence"),
        "ttaaii",
        "cccc",
        F.coalesce("awips_id", F.lit("")).alias("awips_id"),
        "family",
        F.size("parts").alias("segments"),
        F.coalesce(wrapper, F.lit("")).alias("wrapper_id"),
        tsv_field(F.col("path")).alias("source_path"),
    )


def verified(records: DataFrame, *more: str) -> DataFrame:
    """Status of archived records (relative_path and parsed columns, with raw_digest or raw): ok, or error and why; and further columns
    of theirs."""
    stem = F.regexp_replace(F.substring_index("relative_path", "/", -1), r"\.[^.]*$", "")
    digest = F.col("raw_digest") if "raw_digest" in records.columns else hashing.fnv1a(F.col("raw"))
    same = (stem == digest) | stem.startswith(F.concat(digest, F.lit("-")))
    error = F.when(F.col("error_kind").isNotNull(), F.concat_ws(": ", "error_kind", "error_field")).when(~same, F.concat(F.lit("digest mismatch, expected "), digest))
    return records.select("relative_path", F.when(error.isNull(), "ok").otherwise("error").alias("status"), "heading", "family", error.alias("error"), *more)


def fingerprinted(known: DataFrame) -> DataFrame:
    """Add semantic_fingerprint: equal for the same content, whatever its transport, sequence number and line ends."""
    good = known.where(F.col("error_kind").isNull())
    return good.withColumn("semantic_fingerprint", hashing.blake3(hashing.fingerprint_text(F.col("heading"), F.col("awips_id"), F.col("body"))))


def first_of_each(rows: DataFrame, key: str = "semantic_fingerprint") -> DataFrame:
    """The first message of each fingerprint, by path and place; one row of it, if rows are repeated. Rows move once, dealt by their key,
    and each task first drops what cannot be the first, so a fingerprint that many rows have does not gather."""
    place = Window.partitionBy(key).orderBy(F.split("path", "/"), "message_index")
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


#: Columns of parsed messages that a fingerprint, and an archive row, are made of; of segments their number only.
FINGERPRINTED = ("heading", "awips_id", "body", "error_kind")
STORED = (*FINGERPRINTED, "nnn", "cccc", "ttaaii", "sequence_number", "bulletin")
COUNTED = ("dollars",)
#: Columns of parsed messages that an import and its manifest are made of.
IMPORTED = ("error_kind", "sequence_number", "ttaaii", "cccc", "awips_id", "digest", "text_digest")


def stored(rows: DataFrame, source: str, captured_at: Column | None = None, batch: int | None = None) -> DataFrame:
    """Fingerprinted messages as archive rows, with the columns that the archive is partitioned by. batch: of a stream."""
    at = F.current_timestamp() if captured_at is None else captured_at
    pil = F.coalesce("nnn", F.lit("UNKNOWN"))
    return rows.select(
        F.col("semantic_fingerprint").alias("fingerprint"),
        F.col("path").alias("source_path"),
        "message_index",
        at.alias("captured_at"),
        F.lit(source).alias("source"),
        F.col("cccc").alias("office"),
        pil.alias("pil"),
        "awips_id",
        "ttaaii",
        "heading",
        "sequence_number",
        F.size("parts").alias("segments"),
        F.coalesce("family", F.lit("unknown")).alias("family_name"),
        "bulletin",
        F.lit(batch).cast("long").alias("batch"),
        F.date_format(at, "yyyy-MM-dd").alias("capture_date"),
        codes.snake(F.coalesce("family", F.lit("unknown"))).alias("family"),
    )


def write(rows: DataFrame, path: str) -> None:
    """Append archive rows. One file a day and family and task; a day is rebalanced, so no task gets all of it."""
    rows.hint("rebalance", "capture_date", "family").write.mode("append").partitionBy("capture_date", "family").parquet(path)


def days(archive: DataFrame, at: Column, back: int, event_families_only: bool = False) -> DataFrame:
    """Archive rows captured within back - 1 days of a time: both filters prune partitions."""
    reach = min(back, MOST_DAYS) - 1
    date = F.col("capture_date").cast("date")
    out = archive.where(date.between(F.date_sub(at.cast("date"), reach), F.date_add(at.cast("date"), reach)))
    return out.where(~F.col("family").isin(*(f.replace("-", "_") for f in codes.WITHOUT_EVENTS))) if event_families_only else out


def recent(archive: DataFrame, limit: int = 100, office: str | None = None, pil: str | None = None, family: str | None = None) -> DataFrame:
    """The newest records, at most `limit` (1 to 1000), that match the filters."""
    return chosen(archive, office, pil, family).orderBy(F.col("captured_at").desc(), "fingerprint").limit(min(max(limit, 1), 1000))


def chosen(rows: DataFrame, office: str | None = None, pil: str | None = None, family: str | None = None) -> DataFrame:
    """Rows of an office, of identifiers that begin with `pil` and of a family, letter case aside."""
    if office is not None:
        rows = rows.where(F.upper("office") == office.upper())
    if pil is not None:
        rows = rows.where(F.upper(F.coalesce("awips_id", F.lit(""))).startswith(pil.upper()))
    if family is not None:
        rows = rows.where(codes.snake(F.lower("family")) == family.lower().replace("-", "_"))
    return rows


def by_fingerprint(archive: DataFrame, fingerprint: str) -> DataFrame:
    if not fingerprint.isalnum():
        raise ValueError("a fingerprint is letters and digits")
    return archive.where(F.col("fingerprint") == fingerprint).limit(1)


def prune_plan(archive: DataFrame, cutoff: Column) -> DataFrame:
    """Day by day what pruning before a date removes: rows, bytes, and whether the day goes."""
    size = F.octet_length("bulletin")
    per_day = archive.groupBy("capture_date").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))
    return per_day.withColumn("removed", F.col("capture_date").cast("date") < cutoff)


def cutoff(today: Column, keep_days: int = KEEP_DAYS) -> Column:
    return F.date_sub(today, keep_days)


def prune(spark, path: str, before: str) -> list[str]:
    """Remove the partitions of days before a date (YYYY-MM-DD) through the file system that holds the archive."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("capture_date=") and name.removeprefix("capture_date=") < before:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix("capture_date="))
    return sorted(gone)


# --- compaction

#: Folder of the archive with one file for each compaction: the part that it made and the files that it stands for.
_SWAPS = "_swaps"


def _swaps(spark, path: str) -> tuple[set[str], set[str]]:
    """Compactions that were finished, and the files that they stand for."""
    names = [f for f in files_below(spark, f"{path}/{_SWAPS}") if f.endswith(".swap")]
    if not names:
        return set(), set()
    gone = {r.value for r in spark.read.text(names).collect()}
    return {f.rpartition("/")[2].removesuffix(".swap") for f in names}, gone


def _within(path: Column) -> Column:
    """A file's day, family and name, by which it is told: one write gives files of several days the same name. Each row asks, so no
    pattern is searched for along the path."""
    return F.substring_index(path, "/", -3)


def current(spark, path: str) -> DataFrame:
    """The archive as it stands: without files that a compaction replaced, and without those of one that did not finish. The names
    are a filter on file metadata, so such files are not opened. vacuum() keeps the lists short."""
    done, gone = _swaps(spark, path)
    rows, name = spark.read.parquet(path), _within(F.col("_metadata.file_path"))
    made = F.regexp_extract(F.col("_metadata.file_name"), "^compacted-([0-9a-f]+)-", 1)
    keep = (made == "") | made.isin(*done) if done else made == ""
    return rows.where(keep & ~name.isin(*gone)) if gone else rows.where(keep)


def compact(spark, path: str, day: str | list[str], least: int = 2) -> int:
    """Rewrite the small files of a day (YYYY-MM-DD), or of each of some days in one job, as few large ones; how many files were replaced.
    A day of fewer than `least` files stays as it is.

    The new files lie beside the old ones, unseen, until one rename tells that they stand for them: readers that began before go
    on with the old files, later ones take the new, and a compaction that fails leaves nothing but files that nobody reads. Files
    that are appended meanwhile are not touched. vacuum() deletes old files once no reader can need them.
    """
    done, gone = _swaps(spark, path)
    made = lambda f: f.partition("/compacted-")[2].partition("-")[0]
    days, old = [], []
    for d in [day] if isinstance(day, str) else sorted(set(day)):
        names = ["/".join(f.split("/")[-3:]) for f in files_below(spark, f"{path}/capture_date={d}") if f.endswith(".parquet")]
        own = [n for n in names if n not in gone and (not made(n) or made(n) in done)]
        if len(own) >= least:
            days.append(d)
            old += own
    if not days:
        return 0
    tag, staging = uuid.uuid4().hex, f"{path}/_staging-{uuid.uuid4().hex}"
    rows = spark.read.parquet(path).withColumn("capture_date", F.col("capture_date").cast("string"))
    rows = rows.where(F.col("capture_date").isin(*days) & _within(F.col("_metadata.file_path")).isin(*old))
    rows.hint("rebalance", "capture_date", "family").write.partitionBy("capture_date", "family").parquet(staging)
    for i, f in enumerate(x for x in files_below(spark, staging) if x.endswith(".parquet")):
        moved(spark, f, f"{path}/{f.partition(staging.rpartition('/')[2] + '/')[2].rpartition('/')[0]}/compacted-{tag}-{i:05}.parquet")
    spark.createDataFrame([(n,) for n in old], "value string").coalesce(1).write.text(f"{staging}/list")
    moved(spark, next(f for f in files_below(spark, f"{staging}/list") if f.endswith(".txt")), f"{path}/{_SWAPS}/{tag}.swap")
    remove(spark, staging)
    return len(old)


def vacuum(spark, path: str) -> int:
    """Delete replaced files and what unfinished compactions left; to be run when no reader from before a compaction, and no
    compaction, is still at work. How many files were deleted."""
    done, gone = _swaps(spark, path)
    old = []
    for f in files_below(spark, path):
        tag = f.partition("/compacted-")[2].partition("-")[0]
        if "/".join(f.split("/")[-3:]) in gone or (tag and tag not in done) or "/_staging-" in f:
            old.append(f)
    for f in old:
        remove(spark, f)
    # A list is still needed for its tag as long as the part that it made is there; the names in it are gone.
    return len(old)


# --- routes


def routed(rows: DataFrame, rules: list[dict], default: str | None = None) -> DataFrame:
    """One row for each route of a message. rules: name and any of family, cccc, awips_prefix, all of which must fit;
    a message that no rule fits takes the default route, if there is one. Rules are expressions, not a join."""

    def fits(rule: dict) -> Column:
        ok = F.lit(True)
        if rule.get("family") is not None:
            ok = ok & (codes.snake(F.col("family")) == rule["family"].replace("-", "_"))
        if rule.get("cccc") is not None:
            ok = ok & (F.col("cccc") == rule["cccc"])
        if rule.get("awips_prefix") is not None:
            ok = ok & F.coalesce(F.col("awips_id").startswith(rule["awips_prefix"]), F.lit(False))
        return ok

    hits = F.array_compact(F.array(*(F.when(fits(r), F.lit(r["name"])) for r in rules))) if rules else F.array().cast("array<string>")
    if default is not None:
        hits = F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)
    return rows.withColumn("route", F.explode(hits))
