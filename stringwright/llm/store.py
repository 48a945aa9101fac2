"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its columns, that is sent to every executor.
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table as Parquet and read it again: lineage ends here and lost executors cost nothing.

    Column names are kept; an empty table keeps its schema.
    """
    ship(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a settled table for broadcast if its counted rows prove that it is small; else leave it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that were not started with it on their path, and see that no
    more than ``BATCH_ROWS`` rows, which hold whole texts, travel to them at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(prefix="run-"), package)
        context.addPyFile(shutil.make_archive(name, "zip", root, package))
        _shipped.add(context.applicationId)
