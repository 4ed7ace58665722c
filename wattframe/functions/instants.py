"""Instants at the API edge: RFC 3339 text in, typed literals out."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, SparkSession, functions as F, types as T

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
RFC_3339 = re.compile(
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})"
)
RFC_3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00", "Etc/GMT"}


def parse_instant(value: str | datetime) -> datetime:
    """An aware UTC datetime; text must be RFC 3339, naive datetimes are taken as UTC."""
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    elif RFC_3339.fullmatch(value):
        moment = datetime.fromisoformat(value)
    else:
        raise ValueError(f"not an RFC 3339 timestamp: {value!r}")
    return moment.astimezone(timezone.utc)


def time_span(
    from_: str | datetime | None, to: str | datetime | None
) -> tuple[datetime, datetime]:
    """Both ends of a closed range; they default to the Unix epoch and to now."""
    start = EPOCH if from_ is None else parse_instant(from_)
    end = datetime.now(timezone.utc) if to is None else parse_instant(to)
    return start, end


def instant(moment: datetime, data_type: T.DataType) -> Column:
    """``moment`` as a literal of ``data_type`` (TIMESTAMP or TIMESTAMP_NTZ, in UTC)."""
    text = moment.replace(tzinfo=None).isoformat(" ", "microseconds")
    zone = "" if isinstance(data_type, T.TimestampNTZType) else "+00:00"
    return F.lit(text + zone).cast(data_type)


def rfc_3339(ts: Column) -> Column:
    """Format a TIMESTAMP as RFC 3339 text, in the zone of the session."""
    return F.date_format(ts, RFC_3339_FORMAT)


def require_utc(spark: SparkSession) -> None:
    """Calendar buckets and month partitions of TIMESTAMP columns are counted in UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")
