"""Reading series and the registry."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wattframe.functions.instants import time_span
from wattframe.functions.intervals import parse_interval, with_bucket
from wattframe.operators.series import in_range, named
from wattframe.sources.registry import page_rows
from wattframe.tables import Tables

PAGE_SIZE = 5000
META_COLUMNS = ["id", "identifier", "unit", "carrier", "consumption", "description", "local"]
Instant = str | datetime | None


class UnknownSeries(LookupError):
    """No series has the identifier."""


@dataclass(frozen=True)
class Series:
    """One registry row and its datapoints; the row is there even without datapoints."""

    meta: DataFrame
    datapoints: DataFrame


def _with_carrier_names(t: Tables, meta: DataFrame) -> DataFrame:
    names = t.carriers.select(F.col("id").alias("carrier"), F.col("name").alias("carrier_name"))
    return (
        meta.join(names, "carrier", "left")
        .withColumn("carrier", F.col("carrier_name"))
        .select(*META_COLUMNS)
    )


def _series(t: Tables, identifier: str) -> tuple[int, DataFrame]:
    """Id and registry row of a series; of several units the lowest id counts."""
    lowest = t.meta.filter(named(identifier)).agg(F.min("id")).first()[0]
    if lowest is None:
        raise UnknownSeries(identifier)
    return lowest, _with_carrier_names(t, t.meta.filter(F.col("id") == lowest))


def series_scan(t: Tables, identifier: str, from_: Instant = None, to: Instant = None) -> Series:
    """All samples of a series in the closed range, in no order."""
    start, end = time_span(from_, to)
    meta_id, meta = _series(t, identifier)
    samples = in_range(t.ts, start, end).filter(F.col("meta_id") == meta_id)
    return Series(
        meta,
        samples.select(
            "id",
            F.col("series_timestamp").alias("timestamp"),
            F.col("series_value").alias("value"),
            "created_at",
            "updated_at",
        ),
    )


def resample(
    t: Tables, identifier: str, interval: str, from_: Instant = None, to: Instant = None
) -> Series:
    """Mean per bucket in order of time; buckets without samples are left out."""
    step = parse_interval(interval)
    start, end = time_span(from_, to)
    meta_id, meta = _series(t, identifier)
    samples = in_range(t.ts, start, end).filter(F.col("meta_id") == meta_id)
    means = (
        with_bucket(samples, step)
        .groupBy("bucket")
        .agg(F.avg("series_value").alias("mean_value"))
        .orderBy(F.col("bucket").asc_nulls_last())
    )
    return Series(meta, means)


def series_extent(ts: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """First and last timestamp per series: meta_id, min_timestamp, max_timestamp.

    With stored ``extents`` (sources.extents) no sample is read.
    """
    if extents is None:
        extents = ts.select("meta_id", F.col("series_timestamp").alias("first"), F.col("series_timestamp").alias("last"))
    return extents.groupBy("meta_id").agg(
        F.min("first").alias("min_timestamp"), F.max("last").alias("max_timestamp")
    )


def _with_extent(t: Tables, meta: DataFrame, of_these: Column | None = None) -> DataFrame:
    rows = t.ts if t.extents is None else t.extents
    rows = rows if of_these is None else rows.filter(of_these)
    extent = series_extent(rows, None if t.extents is None else rows)
    return meta.join(extent.withColumnRenamed("meta_id", "id"), "id", "left").orderBy("id")


def list_series(t: Tables, page: int = 0, per_page: int = PAGE_SIZE) -> DataFrame:
    """One page of the registry by id, with carrier names and the extent of each series.

    The page is cut before the samples are touched, so only its id span is read. With a page
    directory only the ids around the page are read and sorted, however deep it lies.
    """
    rows, skipped = t.meta, page * per_page
    if t.pages is not None:
        rows, skipped = page_rows(t.meta, t.pages, skipped, per_page)
    return _page(t, rows.orderBy("id").offset(skipped).limit(per_page))


def list_series_after(t: Tables, after: int | None = None, per_page: int = PAGE_SIZE) -> DataFrame:
    """The page of the registry that follows an id; no earlier rows are sorted or skipped."""
    rest = t.meta if after is None else t.meta.filter(F.col("id") > after)
    return _page(t, rest.orderBy("id").limit(per_page))


def _page(t: Tables, rows: DataFrame) -> DataFrame:
    """Names and extents of a page, whose ids, as many as the page is long, are found once."""
    ids = [r.id for r in rows.select("id").collect()]
    rows = t.meta.filter(F.col("id").isin(ids))
    return _with_extent(t, _with_carrier_names(t, rows), F.col("meta_id").isin(ids))


def get_series(t: Tables, identifier: str) -> DataFrame:
    """One registry row with the extent of its samples."""
    meta_id, meta = _series(t, identifier)
    return _with_extent(t, meta, F.col("meta_id") == meta_id)


def series_with_samples(t: Tables) -> DataFrame:
    """Registry rows of series that have any sample."""
    rows = t.ts if t.extents is None else t.extents
    used = rows.select(F.col("meta_id").alias("id")).distinct()
    return _with_carrier_names(t, t.meta.join(used, "id", "left_semi"))
