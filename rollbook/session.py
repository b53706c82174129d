"""Session factory and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and for local runs; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rollbook")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see; a temporary one where none is set and all is one machine."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = f"file://{tempfile.mkdtemp(prefix='rollbook-')}"
        spark.sparkContext.setCheckpointDir(held)
    return held


#: A table of fewer bytes lies in few row groups, which would keep most cores idle.
SMALL_BYTES = 256 << 20


def spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The Parquet table at path; a small one is dealt by key to all cores, a large one is read as it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    rows = spark.read.parquet(path)
    return rows.repartition(spark.sparkContext.defaultParallelism, key) if size < SMALL_BYTES else rows


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rollbook/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def arrive(spark: SparkSession, path: str, at: str) -> None:
    """A finished folder comes where a stream looks for it, whole and at once."""
    jvm = spark.sparkContext._jvm
    start, end = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(at)
    fs = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(end.getParent())
    if not fs.rename(start, end):
        raise OSError(f"{path} could not be moved to {at}")


#: Folders of the tables that table_of() has made inside scratch(), innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that table_of() makes inside go at the end: whatever needs them has to be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        spark = SparkSession.getActiveSession()
        for path in _SCRATCH.pop():
            if spark is not None:
                drop_folder(spark, path)


#: Whether what a query has shuffled goes when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table_of(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts the lineage, and outlives lost executors.

    A table with a path of its own stays; any other goes with the innermost scratch() around. What was shuffled for it goes
    when it is written: nothing reads that again.
    """
    spark = df.sparkSession
    if path is None:
        path = new_folder(spark, name)
        if _SCRATCH:
            _SCRATCH[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
