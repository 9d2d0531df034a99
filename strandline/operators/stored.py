"""Cuts lineage: results of a round are written to the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and the session is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "round") -> DataFrame:
    """Writes df to the shared folder and reads it back; the folder goes at the end of the program, or with ``discard``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    atexit.register(_delete, spark, path)
    return out


#: Bytes of an input, as the planner reckons them, that a task of ``dealt`` takes.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame, like: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as the size of ``like``, that of a file, asks for: what one task sorts or holds doesn't
    grow with the input, whatever the session's number of partitions. Where no size is known, that number holds."""
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 45:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES), *keys)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, spark, path)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote; nothing that is still to be computed may read it."""
    for df in frames:
        _delete(df.sparkSession, df._stored)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  (at exit the session may be gone; a folder left over does no harm)
        pass
