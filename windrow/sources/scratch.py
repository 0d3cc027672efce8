"""Folders for tables that last as long as a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``), deleted when the session's JVM ends."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(top := "file://" + tempfile.mkdtemp(prefix="windrow-"))
    path = f"{top.rstrip('/')}/windrow/{uuid.uuid4().hex}/{name}"
    at = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
