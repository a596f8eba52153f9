"""Cutting lineage through tables written in the folder that all executors share.

`spark.checkpoint.dir` names that folder.  Only a single-machine session (master
`local` or `local[n]`) may leave it unset; it then gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/isoscope-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/isoscope-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def still_there(spark: SparkSession, path: str) -> bool:
    """Whether a scratch path of this session has not been deleted."""
    return path in _written.get(spark.sparkContext.applicationId, [])


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile deletes its shuffle files when it is done; else they stay until
    the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later uses neither recompute the plan nor depend on
    executors that may be lost, and the reader knows the true size."""
    path = scratch_path(df.sparkSession, label)
    with shuffle_files_freed(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._isoscope_path = path
    return table


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables whose last consumer has finished."""
    for table in tables:
        path = getattr(table, "_isoscope_path", None)
        if path:
            delete_path(table.sparkSession, path)
            _written.get(table.sparkSession.sparkContext.applicationId, []).remove(path)


def cleanup(spark: SparkSession) -> int:
    """Delete every intermediate table this session still has; call it once the
    results that read them are written.  Returns how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)
