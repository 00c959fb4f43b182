"""Reading input tables and cutting lineage in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode (tests) a local one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of rows that go to a Python worker at once. Spark's default of 64 MB is several times that in a task.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to BATCH_BYTES where the session leaves Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "67108864"):
        spark.conf.set(key, str(BATCH_BYTES))


#: How written() reaches a local folder. Without Hadoop's native library its checked file system starts three processes (chmod) for a
#: task's file, the raw one two. Until it runs, a process that an executor starts shares all its memory, and a look then counts it twice.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: The pages' own checksums are verified in place of those that the checked file system keeps in files.
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}

#: Paths of the tables that written() has made and nothing has deleted.
_MADE: set[str] = set()


#: Where it is on, Spark deletes the shuffle files of a query when the query ends, not when the driver collects its garbage.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps do not recompute it, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.unregister(release_all)
        atexit.register(release_all)
    _MADE.add(path)
    before = spark.conf.get(CLEANS, "false")
    spark.conf.set(CLEANS, "true")
    try:
        df.write.options(**RAW_FILES).option("parquet.page.write-checksum.enabled", "true").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANS, before)
    # Executors keep the broadcast tables of finished queries until the driver collects its garbage.
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.options(**VERIFIED).schema(df.schema).parquet(path)


def release_all() -> None:
    """Delete what is left of the tables when the process ends: no frame can read them any more."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        release(spark, set(_MADE))


def made() -> set[str]:
    """The tables made so far; for release()."""
    return set(_MADE)


def release(spark: SparkSession, paths: set[str]) -> None:
    """Delete tables made by written(), once nothing lazy still reads them."""
    jvm = spark._jvm
    for name in paths & _MADE:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.discard(name)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames made by written(), once nothing lazy still reads them."""
    for df in frames:
        labels = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        release(df.sparkSession, {p for p in _MADE if p.rsplit("/", 1)[-1] in labels})
