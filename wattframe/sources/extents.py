"""First and last timestamp of each series and month, kept beside the sample table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

EXTENT_SCHEMA = "meta_id int, month date, first timestamp, last timestamp"


def extents_of(samples: DataFrame) -> DataFrame:
    """(meta_id, month, first, last) of samples; sums up before it shuffles."""
    ts = F.col("series_timestamp").cast("timestamp")
    return (
        samples.filter(F.col("meta_id").isNotNull() & ts.isNotNull())
        .groupBy(F.col("meta_id").cast("int").alias("meta_id"), F.trunc(ts.cast("date"), "month").alias("month"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    )


def read_extents(spark: SparkSession, path: str) -> DataFrame:
    """The stored extents, a row per append, series and month; empty if nothing was written yet."""
    try:
        return spark.read.schema(EXTENT_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXTENT_SCHEMA)


def append_extents(samples: DataFrame, path: str) -> None:
    """Add the extents of appended samples; adding them twice changes nothing."""
    extents_of(samples).coalesce(1).write.mode("append").parquet(path)


def rebuild_extents(samples: DataFrame, path: str) -> None:
    """The extents of a whole sample table, as a new table at ``path``.

    For tables that were written without, or whose writer was lost between the samples and
    their extents; it also merges the rows of many appends.
    """
    extents_of(samples).write.mode("errorifexists").parquet(path)
