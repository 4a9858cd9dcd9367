"""Work that has to outlive executors: the shared folder and checkpoints."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named and all runs in one process, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bounds the bytes of the batches that Python workers get, so that long texts don't pile up by the row count."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if held <= 0 or held > limit:
        spark.conf.set(name, str(limit))


def ready(spark: SparkSession) -> None:
    """Makes checkpoint() write to the shared folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))


def collect_garbage(spark: SparkSession) -> None:
    """Between the steps of a long query: the driver's heap shrinks to what is in use, and Spark removes shuffle files and checkpoints that nothing refers to any more, which else waits until the heap happens to fill."""
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, with their lineage cut."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def publish(spark: SparkSession, local: str, kind: str) -> str:
    """Copies a driver's file to the shared folder and hands it to all executors. Returns its name for SparkFiles.get."""
    with open(local, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()[:32]
    name = f"{kind}-{digest}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        part = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/.{name}-{uuid.uuid4().hex}")
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), part)
        if not fs.rename(part, target):
            fs.delete(part, False)
    spark.sparkContext.addFile(target.toString())
    return name
