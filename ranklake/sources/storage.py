"""Shared storage for tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIRS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Intermediate tables must be visible to every executor and outlive any one of
    them, so a cluster session has to name the folder.  A local session without
    the setting (tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="ranklake-")
    return _LOCAL_DIRS[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/ranklake/{uuid.uuid4().hex}/{name}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back.

    Cuts the lineage: later steps reread the table instead of recomputing it,
    also after executors were lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` returned, once all that reads them is stored itself.

    Other DataFrames are ignored, and a table may be given twice.
    """
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
