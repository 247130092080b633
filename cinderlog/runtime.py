"""Session helpers: code on the Python workers, and tables that outlive an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)


#: Rows of a batch for Python workers: Spark's default of 10,000 whole documents is a lot of memory.
BATCH_ROWS = 1000


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package by name, so that they keep module-level caches between tasks.

    Also bounds the batches that they get, unless the session sets a smaller bound itself.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own, if driver and executors
    are one process (local tests); on a cluster, whose machines don't share local folders, RuntimeError."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir: name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="cinderlog-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over as many partitions as there are cores, by a hash of the columns, if it has fewer: a file of one row group is one
    task, however much is to be done with its rows. A table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to a fresh Parquet table in the shared folder and read it back.

    This cuts the lineage: later jobs don't repeat the work, and losing executors loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
