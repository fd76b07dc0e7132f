"""Cutting lineage through the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder. Where it is unset, a local session gets one of this machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from there by what follows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver's process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
