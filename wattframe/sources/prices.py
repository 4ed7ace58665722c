"""Landed market-price files: an index of chunks and one JSON file per chunk."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.functions.instants import EPOCH, instant, parse_instant
from wattframe.functions.sizes import broadcast_if_few

# File names, and the open interval chunk starts must lie in.
CHUNK_NAME = r"(?:^|/)(\w+)_(\w+)_(\w+)_(\d+)\.json$"
CHUNKS_AFTER = "2019-01-01T00:00:00Z"
CHUNKS_BEFORE = "2021-01-01T00:00:00Z"
INDEX_SCHEMA = "timestamps array<bigint>"
CHUNK_SCHEMA = "series array<array<double>>"


def _millis(moment: str | datetime) -> int:
    return round(parse_instant(moment).timestamp() * 1000)


def chunk_wanted(
    start: Column, after: str | datetime = CHUNKS_AFTER, before: str | datetime = CHUNKS_BEFORE
) -> Column:
    """Whether a chunk start, in epoch milliseconds, lies strictly between the bounds."""
    return (start > _millis(after)) & (start < _millis(before))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(chunk) starts named by index files, in epoch milliseconds."""
    index = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)
    return index.select(F.explode("timestamps").alias("chunk"))


def read_chunks(
    spark: SparkSession,
    path: str,
    filter_value: str = "4169",
    region: str = "DE",
    resolution: str = "hour",
) -> DataFrame:
    """(chunk, series) of the landed chunk files of one price series."""
    files = spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
    return with_chunk(
        files.option("pathGlobFilter", chunk_files(filter_value, region, resolution)).json(path)
    )


def chunk_files(filter_value: str, region: str, resolution: str) -> str:
    """Pattern of the names of one price series' files."""
    return f"{filter_value}_{region}_{resolution}_*.json"


def with_chunk(files: DataFrame) -> DataFrame:
    """Add the chunk start that a file carries in its name."""
    name = F.col("_metadata.file_name")
    return files.withColumn("chunk", F.regexp_extract(name, CHUNK_NAME, 4).cast("bigint"))


def wanted_chunks(
    chunks: DataFrame,
    index: DataFrame,
    after: str | datetime = CHUNKS_AFTER,
    before: str | datetime = CHUNKS_BEFORE,
) -> DataFrame:
    """Chunks the index names whose start lies strictly between the bounds."""
    named = index.filter(chunk_wanted(F.col("chunk"), after, before)).select("chunk").distinct()
    wanted = chunks.filter(chunk_wanted(F.col("chunk"), after, before))
    return wanted.join(broadcast_if_few(named), "chunk", "left_semi")


def price_points(chunks: DataFrame) -> DataFrame:
    """(series_timestamp, series_value) of all pairs; pairs without a price are left out."""
    pairs = chunks.select(F.explode("series").alias("pair"))
    return pairs.select(
        F.timestamp_millis(F.col("pair")[0].cast("bigint")).alias("series_timestamp"),
        F.col("pair")[1].alias("series_value"),
    ).filter(F.col("series_value").isNotNull())


def unpriced_points(chunks: DataFrame) -> DataFrame:
    """How many pairs per chunk carry no price."""
    return chunks.select(
        "chunk", F.size(F.filter("series", lambda pair: pair[1].isNull())).alias("unpriced")
    ).filter(F.col("unpriced") > 0)


def high_water_mark(stored: DataFrame, meta_id: int) -> datetime:
    """Newest stored timestamp of a series, or the Unix epoch."""
    newest = F.max("series_timestamp").cast("timestamp")
    micros = stored.filter(F.col("meta_id") == meta_id).agg(F.unix_micros(newest)).first()[0]
    return EPOCH + timedelta(microseconds=micros or 0)


def increment(points: DataFrame, mark: datetime) -> DataFrame:
    """Points newer than the high-water mark."""
    data_type = points.schema["series_timestamp"].dataType
    return points.filter(F.col("series_timestamp") > instant(mark, data_type))
