"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows that a Python worker gets at once. Of parsed texts, framed streams and digests it holds some kilobytes for each.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python workers, once per application, and them smaller batches than the default, unless
    the user has chosen a size."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) == 10_000:
        spark.conf.set(batch, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="wxlake-")), "wxlake_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path("wxlake") / p.relative_to(root)))
        spark.sparkContext.addPyFile(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session gets one of its own where
    none is named, as executors of a cluster could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wxlake-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(held.get()).rstrip("/")


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that settled() writes inside are deleted at the end; what is returned from inside must not read them."""
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        made, _scratch.paths = _scratch.paths, outer
        for path in made:
            remove(spark, path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files in a folder and those in it, hidden ones too; none if there is no such folder."""
    at, fs = _path(spark, path)
    out: list[str] = []
    if fs.exists(at):
        found = fs.listFiles(at, True)
        while found.hasNext():
            out.append(found.next().getPath().toString())
    return out


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file; its new folder is made if there is none."""
    (at, fs), (target, _) = _path(spark, path), _path(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise OSError(f"cannot rename {path} to {to}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: what is read several times is made once, and an executor that is
    lost costs no more than its own part."""
    path = f"{shared_dir(df.sparkSession)}/wxlake/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for work whose cost does not follow from bytes. Behind a shuffle, adaptive
    execution would hand a few megabytes of texts to a single task, and parse them there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores)


def local(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on this machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wxlake")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
