"""What the text operators share: the shared folder, input columns, held-out split, batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at most, unless a single text is longer.
PASS_BYTES = 1 << 19
#: Rows that Python tasks get at once.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session gets one of its own if unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wxlake-"))
        held = sc._jsc.sc().getCheckpointDir()
    return str(held.get()).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder; columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wxlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Remove tables from written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {file.rpartition("/")[0] for file in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def give_back() -> None:
    """Return memory that a fit on the driver has freed to the system; allocators would keep it for the session."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where there is such a call
    if trim is not None:
        trim(0)


def collected(spark: SparkSession) -> None:
    """Have the driver collect its garbage. Only then Spark drops broadcasts and shuffles of plans that are gone, and a job of many
    short steps makes them faster than the driver would come to it by itself."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """The name with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with smaller batches than the default, as texts can be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # not chosen by the user
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample_below(doc_id: str, share: float) -> Column:
    """A pseudo-random, repeatable choice of about `share` of the ids (nulls are not chosen)."""
    if share >= 1:
        return F.col(doc_id).isNotNull()
    return F.coalesce(F.pmod(F.xxhash64(F.col(doc_id), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)), F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
