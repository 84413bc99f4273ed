"""Session settings the engine relies on, and its code on the executors."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from ranklake.sources.storage import fresh_path

_SHIPPED: set[str] = set()


def _package() -> bytes:
    """The modules of this package as a zip."""
    root = Path(os.path.abspath(__file__)).parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers can import this package from now on.

    Batch functions travel to the workers by name.  The package goes to them as a zip under
    ``spark.checkpoint.dir``, once for each application; what modules keep (vocabularies, caches)
    lives as long as a worker.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        path = fresh_path(spark, f"{__name__.partition('.')[0]}.zip")
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
        try:
            stream.write(bytearray(_package()))
        finally:
            stream.close()
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def spark_session(master: str | None = None, app: str = "ranklake", **conf: str) -> SparkSession:
    """Session with adaptive execution, UTC time and this package on its workers.

    ``conf`` keys use ``__`` for the dots of a Spark setting.  Sizes are left to
    the cluster; adaptive execution merges small shuffle partitions and splits
    skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Lists of query terms reach the Parquet reader as such, not as a range.
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())
