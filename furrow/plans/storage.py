"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: (application, base) -> the folder of its tables, which goes when the application ends.
_ROOTS: dict[tuple[str, str], str] = {}


def _until_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the session's spark.checkpoint.dir; tables there go when the application
    ends. Where it is unset, a local session takes a temporary folder of this machine; a cluster's
    executors wouldn't share one, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="furrow-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        _until_exit(spark, base)
    key = (spark.sparkContext.applicationId, base)
    if key not in _ROOTS:
        root = f"{base.rstrip('/')}/furrow-{uuid.uuid4().hex}"
        _until_exit(spark, root)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: what follows restarts from the files."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
