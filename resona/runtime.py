"""Session set-up shared by queries, tests and the benchmark; folders that outlive an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
_OWN_DIR: str | None = None


def prepare(spark: SparkSession) -> SparkSession:
    """Puts this package on the path of the session's Python workers."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it, or else ``setCheckpointDir``; a private
    folder stands in only where driver and executors are one process.
    """
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_by_call.get() if set_by_call.isDefined() else None
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="resona-")
    return _OWN_DIR


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/resona-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
