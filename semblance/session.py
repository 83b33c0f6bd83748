"""Helpers around the Spark session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_kept: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession, *more: str) -> None:
    """Sends this package (and single files beside it) to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # read by the driver alone, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "semblance_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "semblance")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
        for name in more:
            if os.path.exists(os.path.join(root, name)):
                archive.write(os.path.join(root, name), name)
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset: of a local session a
    temporary folder, and of a cluster, whose machines do not share one, an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "semblance-shared")).rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def kept(df: DataFrame, name: str | None = None, **options) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage and outlives lost executors.

    The query's shuffle files go as soon as it is done, for nothing reads them again. A table with a name of the
    caller's is written once: if a run before has finished it, that one is read. It is the caller's to delete.
    """
    spark = df.sparkSession
    path, conf = f"{shared_folder(spark)}/{name or 'semblance-' + uuid.uuid4().hex}", spark.conf
    files, done = _path(spark, f"{path}/_SUCCESS")
    if not (name and files.exists(done)):
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.options(**options).mode("overwrite").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
    if not name:
        _kept.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the table that kept() gave, before drop_kept() does."""
    path = getattr(df, "_kept_at", None)
    if path in _kept:
        _kept.remove(path)
        files, at = _path(df.sparkSession, path)
        files.delete(at, True)


def drop_kept(spark: SparkSession) -> int:
    """Deletes what kept() has written so far; to be called when no DataFrame that reads it is needed any more."""
    n = 0
    while _kept:
        files, at = _path(spark, _kept.pop())
        n += bool(files.delete(at, True))
    return n
