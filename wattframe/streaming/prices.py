"""Continuous ingest of landed price files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wattframe.sources.prices import (
    CHUNK_SCHEMA,
    CHUNKS_AFTER,
    CHUNKS_BEFORE,
    chunk_files,
    chunk_wanted,
    price_points,
    with_chunk,
)
from wattframe.sources.samples import KEYS, LITERALS, append_samples
from wattframe.streaming.log import only_log, own_log

ARRIVALS = "meta_id int, series_timestamp timestamp, series_value double, day date"


def stream_chunks(
    spark: SparkSession,
    landing: str,
    files_per_batch: int = 1000,
    filter_value: str = "4169",
    region: str = "DE",
    resolution: str = "hour",
) -> DataFrame:
    """(chunk, series) of one price series' chunk files as they land; other files are left."""
    files = (
        spark.readStream.schema(CHUNK_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", chunk_files(filter_value, region, resolution))
    )
    return with_chunk(files.json(landing))


def stream_price_samples(
    chunks: DataFrame,
    meta_id: int,
    after: str | datetime = CHUNKS_AFTER,
    before: str | datetime = CHUNKS_BEFORE,
    index: DataFrame | None = None,
) -> DataFrame:
    """Samples of the price series from streamed chunks within the bounds.

    With an ``index`` (chunk) only chunks it names count, as in the batch reader.
    """
    wanted = chunks.filter(chunk_wanted(F.col("chunk"), after, before))
    if index is not None:
        wanted = wanted.join(index.select("chunk").distinct(), "chunk", "left_semi")
    return price_points(wanted).withColumn("meta_id", F.lit(meta_id))


def append_stream(samples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append streamed samples to the table, each (series, timestamp) once.

    Every batch is compared with the stored months it touches, so points that were
    posted before are skipped however late they come again, and a batch that is
    replayed after a failure adds nothing twice.
    """

    def append(batch: DataFrame, _: int) -> None:
        append_samples(batch, path, "skip")

    return (
        samples.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(samples: DataFrame) -> DataFrame:
    """Drop repeated (series, timestamp) pairs by streaming state.

    Unlike ``append_stream`` it needs no table to compare with. Keys are kept for good, so no
    point is ever too late; they are spread over the state stores of all tasks, which grow
    with the data. ``log_arrivals`` keeps them in files by day instead.
    """
    return samples.dropDuplicates(["meta_id", "series_timestamp"])


def log_arrivals(samples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log each (series, timestamp) when it first comes; of copies in a batch the lowest value.

    No state is kept in memory: a batch is compared with what earlier batches logged of the
    days it touches, so repeats are found however late they come, and what is read for
    a batch doesn't grow with the days that are over. A batch never compares with itself,
    so replaying it changes nothing. Samples without a series or a time are left out.
    """
    spark = samples.sparkSession

    def log(batch: DataFrame, number: int) -> None:
        own = own_log(spark, path, "day")
        rows = batch.select(
            F.col("meta_id").cast("int").alias("meta_id"),
            F.col("series_timestamp").cast("timestamp").alias("series_timestamp"),
            F.col("series_value").cast("double").alias("series_value"),
        ).filter(F.col("meta_id").isNotNull() & F.col("series_timestamp").isNotNull())
        once = rows.groupBy(*KEYS).agg(F.min("series_value").alias("series_value"))
        once = once.withColumn("day", F.col("series_timestamp").cast("date"))
        days = [r.day for r in rows.select(F.col("series_timestamp").cast("date").alias("day")).distinct().limit(LITERALS + 1).collect()]
        known = own.read(ARRIVALS, before=number)
        if len(days) <= LITERALS:
            known = known.filter(F.col("day").isin(days))
        new = once.join(known.select("day", *KEYS), ["day", *KEYS], "left_anti")
        own.write(new.repartition("day"), own.batch(number))

    return (
        samples.writeStream.foreachBatch(log)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Every logged sample: meta_id, series_timestamp, series_value."""
    return only_log(spark, path, "day").read(ARRIVALS).drop("day")


def compact_arrivals(spark: SparkSession, path: str) -> None:
    """Merge the batches of a log of arrivals, a file or a few per day."""
    only_log(spark, path, "day").compact(ARRIVALS, lambda rows: rows.repartition("day"))
