"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.

    That is ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.
    Where neither is set, one is made for a local session; a cluster must name its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = context._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as that file system has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = located(spark, path)
    return files.exists(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    each row is computed once, and a lost executor costs no more than its running tasks."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def held(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks while a step is at work: for what is computed from
    stored tables in a few steps, and can be computed again where an executor is lost."""
    return df.persist(StorageLevel.DISK_ONLY)


def release(*tables: DataFrame) -> None:
    """Remove the folders of stored tables, and held ones, that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            files, place = located(table.sparkSession, path)
            files.delete(place, True)
        else:
            table.unpersist()
