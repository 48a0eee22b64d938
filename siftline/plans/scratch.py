"""Tables in the folder that all executors share.

Iterative operators cut their lineage here. The folder is the one that the
session names in ``spark.checkpoint.dir``; only a local session without that
setting gets a temporary one. Tables live until :func:`drop` or the end of the
driver, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_LOCAL: list[str] = []


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The run's folder below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="siftline-"))
        base = _LOCAL[0]
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = _ROOTS[app] = f"{base.rstrip('/')}/siftline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, root)
    return _ROOTS[app]


def _forget(spark: SparkSession, root: str) -> None:
    try:
        fs, p = _fs(spark, root)
        fs.delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for files that workers write and map, so it has to be a mounted path."""
    path = new_path(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise ValueError("spark.checkpoint.dir must be a mounted path that workers can map, got " + path)
    path = path.removeprefix("file://")
    os.makedirs(path)
    return path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live plan needs, now instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
