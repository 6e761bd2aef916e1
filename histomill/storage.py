"""Stored intermediate tables for iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from histomill.errors import InvalidParameterError

_OWN: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def workspace(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach: ``spark.checkpoint.dir`` of the
    session. Only a session of one local process may leave that unset; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/histomill"
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidParameterError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="histomill-"))
    return f"file://{_OWN[0]}"


def claim(spark: SparkSession, name: str) -> str:
    """A path in the workspace that is deleted when the process ends."""
    path = f"{workspace(spark)}/{name}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the workspace and read it back: cuts the lineage with data that outlive
    any executor and that later plans can prune by column."""
    path = claim(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def clear_workspace() -> None:
    """Delete what this process has stored; a long session may call it between jobs."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            break
    while _OWN:
        shutil.rmtree(_OWN.pop(), ignore_errors=True)
