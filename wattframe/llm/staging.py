"""Tables written to the shared folder, so that later jobs restart from files, not from lineage."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

from wattframe.functions.sizes import drop_folder, shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    The shuffle files of the write go with it, for what is written is read from its files alone.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, neither a job nor a lazy result."""
    for table in tables:
        drop_folder(table.sparkSession, _paths.pop(table))
