"""Continuous means per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wattframe.functions.intervals import parse_interval, time_window, with_bucket
from wattframe.streaming.log import only_log, own_log

SUMS = "meta_id int, bucket timestamp, total double, samples long"
MEANS = "meta_id int, bucket timestamp, mean_value double, batch int"


def log_means(samples: DataFrame, interval: str, path: str, checkpoint: str) -> StreamingQuery:
    """Log sum and number of the samples of each batch per series and bucket.

    Sums add up whatever the order of arrival, so no sample is ever too late, no state
    is kept, and month and year buckets work as well. A batch replaces its own folder,
    named by its query and number: replaying it changes nothing. A log takes one query,
    the one of its checkpoint; another one, or a lost checkpoint, is refused. Samples that
    may repeat go through the sample table first, see streaming.prices.
    """
    step, spark = parse_interval(interval), samples.sparkSession

    def log(batch: DataFrame, number: int) -> None:
        sums = (
            with_bucket(batch, step)
            .groupBy(F.col("meta_id").cast("int").alias("meta_id"), "bucket")
            .agg(F.sum("series_value").alias("total"), F.count("series_value").alias("samples"))
        )
        own = own_log(spark, path)
        own.write(sums, own.batch(number))

    return (
        samples.writeStream.foreachBatch(log)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def logged_means(spark: SparkSession, path: str) -> DataFrame:
    """Mean per series and bucket over all batches so far."""
    return (
        _summed(only_log(spark, path).read(SUMS))
        .select("meta_id", "bucket", F.try_divide("total", "samples").alias("mean_value"))
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("meta_id", "bucket").agg(
        F.sum("total").alias("total"), F.sum("samples").alias("samples")
    )


def compact_means(spark: SparkSession, path: str) -> None:
    """Add up the batches of a log of sums, so that their number stays bounded.

    Readers and the writing query may go on meanwhile; one compaction may run at a time.
    """
    only_log(spark, path).compact(SUMS, _summed)


def follow_means(samples: DataFrame, interval: str, path: str, checkpoint: str) -> StreamingQuery:
    """Log the mean of every bucket that a batch changes, open buckets included.

    Spark keeps the sums of all buckets, so no sample is too late; they are spread over the
    state stores of all tasks. ``log_means`` needs no state. Batches are logged as there: by
    query and number, and a second query or a lost checkpoint is refused.
    """
    window = time_window(F.col("series_timestamp"), interval)
    means = samples.groupBy("meta_id", window.alias("window")).agg(F.avg("series_value").alias("mean_value"))
    spark = samples.sparkSession

    def log(batch: DataFrame, number: int) -> None:
        rows = batch.select(
            F.col("meta_id").cast("int").alias("meta_id"), F.col("window")["start"].alias("bucket"), "mean_value", F.lit(number).alias("batch")
        )
        own = own_log(spark, path)
        own.write(rows, own.batch(number))

    return (
        means.writeStream.outputMode("update")
        .foreachBatch(log)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def followed_means(spark: SparkSession, path: str) -> DataFrame:
    """Latest mean per series and bucket."""
    return _latest(only_log(spark, path).read(MEANS)).drop("batch")


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("meta_id", "bucket").agg(
        F.max_by("mean_value", "batch").alias("mean_value"), F.max("batch").alias("batch")
    )


def compact_followed_means(spark: SparkSession, path: str) -> None:
    """Keep the latest mean of each bucket, as ``compact_means`` does for sums."""
    only_log(spark, path).compact(MEANS, _latest)
