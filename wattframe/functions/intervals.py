"""Interval text such as ``15min`` or ``3month`` and the buckets it defines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wattframe.functions.instants import require_utc

# The interval grammar and the instants buckets are counted from.
SECONDS_PER_UNIT = {"min": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
MONTHS_PER_UNIT = {"month": 1, "year": 12}
INTERVAL_PATTERN = re.compile(r"([0-9]+)(min|hour|day|week|month|year)")
MAX_COUNT = 2**31 - 1
FIXED_ORIGIN = datetime(2000, 1, 3, tzinfo=timezone.utc)  # a Monday
EARLIEST = datetime.min.replace(tzinfo=timezone.utc)
LATEST = datetime.max.replace(tzinfo=timezone.utc)
CALENDAR_ORIGIN = "2000-01-01"


@dataclass(frozen=True)
class Interval:
    """A bucket width: either a number of calendar months or of seconds."""

    months: int = 0
    seconds: int = 0


def parse_interval(text: str | Interval) -> Interval:
    """Read ``<count><unit>``; anything else, or a zero width, is a ValueError."""
    if isinstance(text, Interval):
        return text
    match = INTERVAL_PATTERN.fullmatch(text)
    count = int(match[1]) if match else 0
    if not 0 < count <= MAX_COUNT:
        raise ValueError(f"invalid interval: {text!r}")
    unit = match[2]
    if unit in MONTHS_PER_UNIT:
        return Interval(months=count * MONTHS_PER_UNIT[unit])
    return Interval(seconds=count * SECONDS_PER_UNIT[unit])


def _origin_offset(step: Interval) -> int:
    return int(FIXED_ORIGIN.timestamp()) % step.seconds


def time_window(ts: Column, interval: str | Interval) -> Column:
    """Tumbling window struct (start, end); fixed widths only, so it also suits streams."""
    step = parse_interval(interval)
    if step.months:
        raise ValueError("month and year buckets have no fixed width")
    return F.window(ts, f"{step.seconds} seconds", startTime=f"{_origin_offset(step)} seconds")


def time_bucket(
    ts: Column, interval: str | Interval, data_type: T.DataType = T.TimestampType()
) -> Column:
    """Start of the bucket holding ``ts``; ``data_type`` is the type of ``ts``.

    Weeks start on Monday and n-month buckets count from January 2000.
    """
    step = parse_interval(interval)
    if step.seconds:
        return time_window(ts, step).getField("start")
    elapsed = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
    start = elapsed - F.pmod(elapsed, F.lit(step.months))
    return F.add_months(F.lit(CALENDAR_ORIGIN).cast("date"), start).cast(data_type)


def with_bucket(
    df: DataFrame, interval: str | Interval, ts: str = "series_timestamp", name: str = "bucket"
) -> DataFrame:
    """Add the bucket start of ``ts`` as column ``name``, in the type of ``ts``."""
    step, data_type = parse_interval(interval), df.schema[ts].dataType
    if step.months and isinstance(data_type, T.TimestampType):
        require_utc(df.sparkSession)
    return df.withColumn(name, time_bucket(F.col(ts), step, data_type))


def whole_buckets(
    interval: str | Interval, start: datetime, end: datetime
) -> tuple[datetime, datetime]:
    """Smallest span of whole buckets covering [start, end]; its upper end is exclusive.

    Ends beyond what a datetime holds are its first or last moment.
    """
    step = parse_interval(interval)
    if step.months:

        def month_start(index: int) -> datetime:
            year = 2000 + index // 12
            if year < 1:
                return EARLIEST
            return LATEST if year > 9999 else datetime(year, index % 12 + 1, 1, tzinfo=timezone.utc)

        def month_index(moment: datetime) -> int:
            index = (moment.year - 2000) * 12 + moment.month - 1
            return index - index % step.months

        return month_start(month_index(start)), month_start(month_index(end) + step.months)

    def place(moment: datetime, whole: int) -> datetime:
        """Start of the moment's bucket, ``whole`` buckets on, within what a datetime holds."""
        index = (moment - FIXED_ORIGIN) // timedelta(seconds=1) // step.seconds + whole
        seconds = index * step.seconds
        if seconds <= (EARLIEST - FIXED_ORIGIN).total_seconds():
            return EARLIEST
        if seconds >= (LATEST - FIXED_ORIGIN).total_seconds():
            return LATEST
        return FIXED_ORIGIN + timedelta(seconds=seconds)

    return place(start, 0), place(end, 1)
