"""Sums of samples per series and hour, kept by month beside the sample table.

A month is summed apart from all others: the first sample of each hour is stored as it is and
weighed when the table is read, so an append only makes the months it touches new.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.functions.instants import instant
from wattframe.functions.intervals import Interval
from wattframe.operators.weights import CHUNK, HOUR, OPEN_AFTER, OPEN_VALUE, OPENING, chunk_sums
from wattframe.sources.samples import month_of, read_samples

HOURLY_SCHEMA = (
    f"meta_id int, {CHUNK} timestamp, kwh double, kwh_used double, amount double, samples long, "
    f"{OPENING} timestamp, {OPEN_VALUE} double, {OPEN_AFTER} timestamp, first timestamp, last timestamp, month date"
)
ONE_HOUR = timedelta(hours=1)
MOMENT = timedelta(microseconds=1)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """The stored sums; empty if nothing was written yet."""
    try:
        return spark.read.schema(HOURLY_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HOURLY_SCHEMA)


def touched_months(batch: DataFrame) -> list[date]:
    """Months of a batch of samples."""
    return sorted(r.month for r in batch.select(month_of("series_timestamp").alias("month")).distinct().collect() if r.month)


def refresh_hourly(spark: SparkSession, samples: str, path: str, months: list[date] | None = None) -> None:
    """Sum the given months of the sample table anew, all if none are given.

    Each month replaces its own folder, so a run that is repeated changes nothing. After an
    append the months of the batch are due; one writer at a time.
    """
    rows = read_samples(spark, samples)
    if months is not None:
        rows = rows.filter(F.col("month").isin(months))
    sums = chunk_sums(rows.select("meta_id", "series_timestamp", "series_value"), chunk=HOUR)
    sums = sums.withColumn("month", F.trunc(F.col(CHUNK).cast("date"), "month"))
    (
        sums.repartitionByRange("month", "meta_id", CHUNK)
        .sortWithinPartitions("month", "meta_id", CHUNK)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def fits(step: Interval) -> bool:
    """Whether buckets of this width begin and end with whole hours."""
    return bool(step.months) or step.seconds % 3600 == 0


def whole_hours(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The whole hours in a closed range: the first one and the end of the last one."""
    floor = lambda moment: moment.replace(minute=0, second=0, microsecond=0)
    first = floor(start)
    first = first if first == start else first + ONE_HOUR
    return first, floor(end + MOMENT)


def hours_between(hourly: DataFrame, first: datetime, past: datetime) -> DataFrame:
    """Stored sums of the hours from ``first`` until ``past``; names the month partition too."""
    months = [F.lit(f"{m.year:04}-{m.month:02}-01").cast("date") for m in (first, past)]
    kind = hourly.schema[CHUNK].dataType
    return hourly.filter(F.col("month").between(*months)).filter(
        (F.col(CHUNK) >= instant(first, kind)) & (F.col(CHUNK) < instant(past, kind))
    ).drop("month")
