"""Counts that decide between plans, and the folder for durable intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is counted to have at most ``rows`` rows, else sort and merge.

    Only ``rows + 1`` rows are counted. Spark's own estimate isn't asked, for it doesn't see
    how many rows an explode makes.
    """
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df.hint("merge")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and its size is known."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """A folder and its file system; the one place that reaches for Hadoop's classes."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a staged table once nothing reads it any more."""
    folder, files = _files(spark, path)
    files.delete(folder, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    folder, files = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
