"""Folders for what a session writes for itself."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidelog.errors import InvalidArgumentError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster
    each executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        at = sc._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise InvalidArgumentError(f"spark.checkpoint.dir names no folder that the executors of {sc.master} share")
        found = tempfile.mkdtemp(prefix="tidelog-checkpoints-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder there, which goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path
