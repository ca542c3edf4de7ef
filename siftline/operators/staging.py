"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_RUNS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below the one that the cluster names in spark.checkpoint.dir; removed when the session's JVM ends.

    Where that is unset, a temporary folder serves a local master, as in tests; any other master is refused, as its
    executors couldn't read what the others wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="siftline-"))
            atexit.register(lambda: __import__("shutil").rmtree(_OWN[0], ignore_errors=True))
        return "file://" + os.path.abspath(_OWN[0])
    key = (named, spark.sparkContext.applicationId)
    if key not in _RUNS:
        _RUNS[key] = f"{named.rstrip('/')}/siftline-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_RUNS[key])
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _RUNS[key]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the written table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
