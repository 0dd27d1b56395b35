"""What a job needs from its cluster: this package on every worker, and a folder that all of them share.

Tables that a job keeps for itself go under the folder that
``spark.checkpoint.dir`` names (or the SparkContext's checkpoint folder), the one
place that the driver and all executors share.  Only where neither is set and the
master is local (plain tests) is a temporary folder made and set; a cluster
without such a folder is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_lock = threading.Lock()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in the workers of a session, wherever they start; once a session."""
    sc = spark.sparkContext
    with _lock:
        if getattr(sc, "_sessionloom_shipped", False):
            return
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(package):
            root = os.path.dirname(package)
            target = os.path.join(tempfile.mkdtemp(prefix="sessionloom-"), "sessionloom_src.zip")
            with zipfile.ZipFile(target, "w") as out:
                for at, _, names in os.walk(package):
                    for name in names:
                        if name.endswith(".py"):
                            full = os.path.join(at, name)
                            out.write(full, os.path.relpath(full, root))
            sc.addPyFile(target)
        sc._sessionloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A folder URI that the driver and every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sessionloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") + "/sessionloom"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path for one run's tables; removed at exit."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: after it, a lost executor costs a reread of shared
    files and not the work that made them.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sessionloom_path = path
    return out


def drop(table: DataFrame) -> None:
    """Remove a staged table all of whose readers have been written themselves."""
    delete(table.sparkSession, table._sessionloom_path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever its scheme."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(jsc.hadoopConfiguration()).exists(at))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session is gone; nothing to clean with
            return
