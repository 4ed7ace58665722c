"""Energy of power series and shares of the grid mix."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattframe.functions.intervals import parse_interval, with_bucket
from wattframe.operators.series import SeriesSet, choose, grid_mix, of_series, samples_of
from wattframe.operators.weights import CHUNK, chunk_sums, joined_sums, weighed_sums
from wattframe.sources.hourly import MOMENT, fits, hours_between, whole_hours
from wattframe.tables import Tables


def series_energy(t: Tables, series: SeriesSet, start: datetime, end: datetime) -> DataFrame:
    """Energy per series over the whole range, negative power included."""
    return _energy(t, series, None, start, end).select("meta_id", "kwh")


def bucket_energy(
    t: Tables, series: SeriesSet, interval: str, start: datetime, end: datetime
) -> DataFrame:
    """Energy per series and bucket, before any registry attribute is joined.

    ``kwh`` is the plain sum, ``kwh_used`` counts each negative sample as zero; ``amount`` and
    ``samples`` are sum and number of the plain values.
    """
    return _energy(t, series, interval, start, end)


def _energy(
    t: Tables, series: SeriesSet, interval: str | None, start: datetime, end: datetime
) -> DataFrame:
    """Sums per series and bucket, without an interval per series.

    With a table of hourly sums the whole hours of the range come from there, where buckets are
    made of whole hours; samples are read for the hours that the range cuts only.
    """
    by = [] if interval is None else ["bucket"]
    if t.hourly is None or t.weighting != "chunked" or (by and not fits(parse_interval(interval))):
        samples = samples_of(t, series, start, end)
        samples = with_bucket(samples, interval) if by else samples
        return weighed_sums(samples, *by, weighting=t.weighting, chunk=t.chunk)
    first, past = whole_hours(start, end)
    if first >= past:
        return _energy(replace(t, hourly=None), series, interval, start, end)
    sums = of_series(hours_between(t.hourly, first, past), series)
    for low, high in ((start, first - MOMENT), (past, end)):
        if low <= high:
            sums = sums.unionByName(chunk_sums(samples_of(t, series, low, high)))
    sums = with_bucket(sums, interval, CHUNK) if by else sums
    return joined_sums(sums, *by)


def role_buckets(
    t: Tables,
    roles: dict[str, Column],
    keys: dict[str, list[str]],
    interval: str,
    start: datetime,
    end: datetime,
) -> DataFrame:
    """Sums per bucket, role and the role's keys (registry columns), all from one scan.

    A series of several roles counts in each of them. Columns: bucket, role, all keys (NULL for
    roles without them), and the sums of ``bucket_energy``.
    """
    flags = [F.coalesce(role, F.lit(False)).alias(f"is_{name}") for name, role in roles.items()]
    columns = sorted({column for own in keys.values() for column in own})
    series = choose(t, reduce(lambda a, b: a | b, roles.values()), *columns, *flags)
    rows = series.describe(bucket_energy(t, series, interval, start, end))
    held = F.array_compact(F.array(*(F.when(F.col(f"is_{name}"), F.lit(name)) for name in roles)))
    rows = rows.withColumn("role", F.explode(held))
    own = [
        F.when(F.col("role").isin([name for name in keys if column in keys[name]]), F.col(column)).alias(column)
        for column in columns
    ]
    return rows.groupBy("bucket", "role", *own).agg(
        *(F.sum(c).alias(c) for c in ("kwh", "kwh_used", "amount", "samples"))
    )


def with_carrier_name(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows that have a carrier, with its name."""
    names = t.carriers.select(F.col("id").alias("carrier"), F.col("name").alias("carrier_name"))
    return rows.join(names, "carrier")


def _share(amount: Column, total: Column, on_zero: str) -> Column:
    """A zero total fails the job, or gives NULL with ``on_zero="null"``."""
    if on_zero not in ("error", "null"):
        raise ValueError(f"unknown handling of zero totals: {on_zero!r}")
    return amount / total if on_zero == "error" else F.try_divide(amount, total)


def shares(t: Tables, rows: DataFrame, on_zero: str = "error") -> DataFrame:
    """Share of each carrier in the ``amount`` per bucket: bucket, carrier, carrier_name, share.

    A bucket whose total is zero fails the job, or has NULL shares with ``on_zero="null"``.
    """
    mix = (
        with_carrier_name(t, rows)
        .groupBy("bucket", "carrier", "carrier_name")
        .agg(F.sum("amount").alias("amount"))
    )
    total = F.sum("amount").over(Window.partitionBy("bucket"))
    share = _share(F.col("amount"), total, on_zero)
    return mix.select("bucket", "carrier", "carrier_name", share.alias("share"))


def with_shares(t: Tables, rows: DataFrame, drawn: Column, on_zero: str = "error") -> DataFrame:
    """Rows of ``role_buckets`` with ``carrier_name``, ``share`` and ``drawn``.

    Rows of the mix have their share in the bucket's amount; those without a carrier go.
    ``drawn`` lists, for every row, the given column of the bucket's grid rows. A bucket has
    a few rows per carrier, so one window over it takes the place of joins.
    """
    names = t.carriers.select(F.col("id").alias("carrier"), F.col("name").alias("carrier_name"))
    rows = rows.join(names, "carrier", "left")
    mix = F.col("role") == "mix"
    rows = rows.filter(~mix | F.col("carrier_name").isNotNull())
    bucket = Window.partitionBy("bucket")
    total = F.sum(F.when(mix, F.col("amount"))).over(bucket)
    grid = (F.col("role") == "grid") & F.col("bucket").isNotNull()
    rows = rows.withColumns({"total": total, "drawn": F.collect_list(F.when(grid, drawn)).over(bucket)})
    return rows.withColumn("share", F.when(mix, _share(F.col("amount"), F.col("total"), on_zero)))


def mix_shares(
    t: Tables, interval: str, start: datetime, end: datetime, on_zero: str = "error"
) -> DataFrame:
    """Shares of the grid mix on their own, without weighing any sample."""
    series = choose(t, grid_mix(), "carrier")
    rows = with_bucket(samples_of(t, series, start, end), interval)
    sums = rows.groupBy("meta_id", "bucket").agg(F.sum("series_value").alias("amount"))
    return shares(t, series.describe(sums), on_zero)
