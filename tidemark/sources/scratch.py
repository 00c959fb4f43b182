"""Folders for tables that a query writes on its way."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the process ends; a temporary one only in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        return f"file://{path}/{name}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clean)
    _MADE.append(path)
    return path


def clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for name in _MADE:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
