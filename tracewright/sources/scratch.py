"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; for a session without one, and only if it runs on this machine alone, a temporary folder (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not folder:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)
#: Weak references to what reads the tables stored in the context of `owned`.
_READERS: ContextVar[list | None] = ContextVar("readers", default=None)
#: By application: folders whose tables may still be read, with those references.
_OWNED: dict[str, list[tuple[str, list]]] = {}


@contextmanager
def under(spark: SparkSession, name: str) -> Iterator[str]:
    """Within this context tables are stored in a folder of their own, which `drop` can delete as a whole once nothing reads them any more."""
    token = _FOLDER.set(f"{shared_folder(spark)}/tracewright/{name}-{uuid.uuid4().hex}")
    try:
        yield _FOLDER.get()
    finally:
        _FOLDER.reset(token)


@contextmanager
def owned(spark: SparkSession, name: str) -> Iterator[str]:
    """As `under`, with a folder that belongs to what comes of its tables: `release` deletes it once no DataFrame of this session reads one of them any more."""
    token = _READERS.set([])
    try:
        with under(spark, name) as folder:
            yield folder
        _OWNED.setdefault(spark.sparkContext.applicationId, []).append((folder, _READERS.get()))
    finally:
        _READERS.reset(token)


def release(spark: SparkSession) -> None:
    """Delete the owned folders that nothing reads any more. DataFrames that are still held, also in part of other ones, keep theirs."""
    held = _OWNED.get(spark.sparkContext.applicationId, [])
    if not held:
        return
    context = spark.sparkContext
    for _ in range(2):  # plans stay until the listeners have heard of their jobs' ends
        context._jsc.sc().listenerBus().waitUntilEmpty()
        gc.collect()  # Python's handles of the JVM's plans
        context._jvm.System.gc()
        for entry in list(held):
            if all(reader.refersTo(None) for reader in entry[1]):
                held.remove(entry)
                drop(spark, entry[0])
        if not held:
            return
        time.sleep(0.3)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, is computed once."""
    folder = _FOLDER.get() or f"{shared_folder(df.sparkSession)}/tracewright"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    readers = _READERS.get()
    if readers is not None:  # all plans made of this table share the index of its files
        readers.append(df.sparkSession._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location()))
    return out


def drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables that operators wrote under the shared folder; results that still read them must be written before. Caches that are kept stay."""
    drop(spark, f"{shared_folder(spark)}/tracewright")
