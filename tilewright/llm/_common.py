"""Shared plumbing: materialised intermediates in the cluster's shared folder and Arrow batch limits."""

from __future__ import annotations

import atexit
import gc
import string
import sys
import time
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: whole texts of any length pass, one long text makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
_folders: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: batches of whole texts hold few rows and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder beside the warehouse where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _folders:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM is already gone
            return


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost
    executors, because the folder is shared by all of them. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def written_bytes(df: DataFrame) -> int:
    """Bytes of a table of ``materialise``."""
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def discard(df: DataFrame) -> None:
    """Remove a table of ``materialise`` that no result needs any more."""
    entry = (df.sparkSession, df.written_at)
    _remove(*entry)
    _folders.remove(entry)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over. They go when the driver's JVM collects what refers to them, which is
    not before its listeners have heard of the job's end."""
    for _ in range(2):
        time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def per_worker(name: str, make):
    """What ``make`` returns, made once for each Python worker; task functions come pickled by value, so a module's own
    globals would be made anew for each task."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z only. Texts of ASCII alone take the much faster general function, which then does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
