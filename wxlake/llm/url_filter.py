"""URL filtering against rules in a sorted digest array.

A rule is a host and a path beginning (`example.net/en/`); it covers the host and its subdomains where the
URL's path starts with the rule's. The index is three files: the sorted 64-bit xxhash keys, the byte offset
of each key's entry, and the entries (`A` or `B` for allow or block, then the full rule). Spark's own file
distribution brings them to every executor, where each Python worker maps them into memory, probes the keys
of all host endings times path beginnings of a batch with one vectorised binary search, and confirms each
hit against the full string, so a collision cannot decide.

The index is built on the driver and must stay below `most` bytes; larger rule sets take join_judge, an
equi-join on the same probes that never leaves Spark.

Defined cases: a null URL or one without `://` has an empty host and path and matches nothing; the longest
matching rule wins, and of equal texts the blocking one; without a rule the verdict is allow; rules that are
null or without a host are ignored; repeated rows and null ids yield a row each; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_mapped: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def host_of(url: str) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Index:
    """Names of the distributed files, and the shapes that rules have: label count -> host length -> path lengths (in
    code points). Only these are probed, so a URL costs no more than the rules' shapes, however long it is."""

    name: str
    shapes: dict[int, dict[int, list[int]]]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.name not in _mapped:
            where = [SparkFiles.get(f"{self.name}.{part}") for part in ("keys", "offsets", "entries")]
            _mapped[self.name] = tuple(np.memmap(p, t, "r") if os.path.getsize(p) else np.zeros(0, t) for p, t in zip(where, ("<u8", "<i8", "u1"), strict=True))
        return _mapped[self.name]


#: Hosts fold A-Z only, and so do rules.
_FOLDED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def entries(rules: list[tuple[str, str | None, str]]) -> tuple[np.ndarray, np.ndarray, bytes, dict[int, dict[int, list[int]]]]:
    """Sorted keys, offsets of their entries, the entries, and the shapes of (host, path, verdict) rules."""
    best: dict[str, str] = {}
    shapes: dict[int, dict[int, list[int]]] = {}
    for host, path, verdict in rules:
        if not host:
            continue
        text = host.translate(_FOLDED) + (path or "")
        own = shapes.setdefault(host.count(".") + 1, {}).setdefault(len(host), [])
        if len(path or "") not in own:
            own.append(len(path or ""))
        if best.get(text) != "block":
            best[text] = verdict
    coded = sorted((xxhash.xxh64_intdigest(t.encode()), (("B" if v == "block" else "A") + t).encode()) for t, v in best.items())
    keys = np.array([k for k, _ in coded], "<u8")
    offsets = np.concatenate([[0], np.cumsum([len(e) for _, e in coded], dtype=np.int64)]).astype("<i8")
    return keys, offsets, b"".join(e for _, e in coded), shapes


def build(rules: DataFrame, most: int = 1 << 30) -> Index:
    """Index the rules (host, path, verdict) and hand the files to the executors."""
    spark = rules.sparkSession
    size = rules.agg(F.coalesce(F.sum(F.length("host") + F.coalesce(F.length("path"), F.lit(0)) + 17), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the rules need about {size} bytes, more than {most}; use join_judge")
    rows = rules.where(F.col("host").isNotNull()).select("host", "path", "verdict").toArrow().to_pylist()
    keys, offsets, data, shapes = entries([(r["host"], r["path"], r["verdict"]) for r in rows])
    name, folder = f"rules-{uuid.uuid4().hex}", os.path.realpath(tempfile.mkdtemp(prefix="wxlake-"))
    for part, content in (("keys", keys.tobytes()), ("offsets", offsets.tobytes()), ("entries", data)):
        with open(f"{folder}/{name}.{part}", "wb") as f:
            f.write(content)
        spark.sparkContext.addFile(f"{folder}/{name}.{part}")
    return Index(name, shapes)


def probes(host: str, path: str, shapes: dict[int, dict[int, list[int]]]) -> list[str]:
    """Every rule text that could cover the URL, the longest first."""
    found, at = set(), len(host) + 1
    for labels in range(1, max(shapes, default=0) + 1 if host else 1):
        if at <= 0:
            break
        at = max(0, host.rfind(".", 0, at - 1) + 1) if at > 1 else 0
        end = host[at:]
        found |= {end + path[:n] for n in shapes.get(labels, {}).get(len(end), ()) if n <= len(path)}
    return sorted(found, key=lambda t: (-len(t), t))


def judge(pages: DataFrame, index: Index) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    kind = dict(pages.dtypes)["page_id"]
    given = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, offsets, data = index.arrays()
        for batch in batches:
            rows, texts = [], []
            for i, (h, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = probes(h, p, index.shapes)
                rows += [i] * len(own)
                texts += own
            rule: list[str | None] = [None] * batch.num_rows
            verdict = ["allow"] * batch.num_rows
            digest = np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64)
            at = np.searchsorted(keys, digest)
            hits = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, max(0, len(keys) - 1))] == digest)) if len(keys) else []
            for j in hits:
                i, k = rows[j], int(at[j])
                while rule[i] is None and k < len(keys) and keys[k] == digest[j]:  # equal keys stand side by side
                    entry = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    if entry[1:] == texts[j]:
                        rule[i], verdict[i] = entry[1:], "block" if entry[0] == "B" else "allow"
                    k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return given.transform(common.mapped, run, f"page_id {kind}, host string, path string, rule string, verdict string")


def join_judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """judge() for rule sets of any size: the probes are joined with the rules' texts."""
    path = F.coalesce("path", F.lit(""))
    known = rules.where(F.length("host") > 0).withColumns({"labels": F.size(F.split("host", r"\.")), "n": F.length(path)})
    texts = known.select(F.concat(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path).alias("rule"), F.col("verdict").alias("said"))
    texts = texts.groupBy("rule").agg(F.when(F.max((F.col("said") == "block").cast("int")) == 1, "block").otherwise("allow").alias("said"))
    shapes = [(r["labels"], r["n"]) for r in known.select("labels", "n").distinct().collect()]  # label counts and path lengths, a handful
    given = common.written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of("url").alias("host"), path_of("url").alias("path")), "pages")
    ends = lambda c, n: F.concat(F.substring_index("host", ".", -c), F.substring("path", 1, n))
    texts_of = [F.when(F.length("path") >= n, ends(c, n)) for c, n in shapes]
    probe = given.where("host <> ''").select("row", F.explode(F.array_distinct(F.array_compact(F.array(*texts_of) if shapes else F.array().cast("array<string>")))).alias("rule"))
    best = probe.join(texts, "rule").groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "said")).alias("best"))
    return given.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit("allow")).alias("verdict"))
