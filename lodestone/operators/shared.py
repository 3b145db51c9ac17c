"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode one of our own where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: list[tuple[SparkSession, str]] = []


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner sweeps it
        pass


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        _drop(spark, path)


def settle(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: short lineage, and nothing is computed twice. It goes when the program ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a settled table that no later result reads."""
    for name in df.inputFiles()[:1]:
        _drop(df.sparkSession, name.rsplit("/", 1)[0])
