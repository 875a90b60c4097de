"""Intermediate tables that several branches of a job read.

A staged table is written once to the shared folder named by ``spark.checkpoint.dir`` and read back, so lost executors
cost a re-read and not a recomputation, and the planner knows the table's size: a small staged side is broadcast by
``spark.sql.autoBroadcastJoinThreshold``, a large one is shuffled.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_staged: list[str] = []
_open = threading.local()  # the scratches that this thread has open, innermost last


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one, removed at exit, only for a local master without a setting."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if _local_root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _local_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the staging folder; ``remove_staged`` deletes what is there."""
    path = f"{staging_root(spark)}/retrievo/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    for own in getattr(_open, "scratches", [])[-1:]:
        own.paths.append(path)
    return path


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in the staging folder and return the table read back."""
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that is not read any more."""
    read = {part for file in df.inputFiles() for part in file.split("/")}
    for path in [p for p in _staged if p.rsplit("/", 1)[1] in read]:
        for paths in (_staged, *(own.paths for own in getattr(_open, "scratches", []))):
            if path in paths:
                paths.remove(path)
        _delete(df.sparkSession, path)


class Scratch:
    """What was staged inside, and the tables that outlive it."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Let what ``df`` reads stay."""
        self.kept.append(df)
        return df


@contextmanager
def scratch(spark: SparkSession):
    """At its end, what was staged inside is deleted, except for the files that a kept table reads."""
    own = Scratch()
    _open.scratches = [*getattr(_open, "scratches", []), own]
    try:
        yield own
    except BaseException:
        own.kept = []
        raise
    finally:
        _open.scratches.pop()
        read = {part for df in own.kept for file in df.inputFiles() for part in file.split("/")}
        for path in own.paths:
            if path.rsplit("/", 1)[1] in read:
                for outer in _open.scratches[-1:]:
                    outer.paths.append(path)
            else:
                _staged.remove(path)
                _delete(spark, path)


def remove_staged(spark: SparkSession) -> int:
    """Delete what this process has staged, once no result that reads it is needed any more."""
    removed = 0
    while _staged:
        removed += _delete(spark, _staged.pop())
    return removed
