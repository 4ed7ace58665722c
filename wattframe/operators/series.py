"""Choosing series by role or key, and reading only their samples."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wattframe.functions.instants import instant
from wattframe.functions.text import key
from wattframe.tables import Tables

# Identifiers with a meaning of their own.
TOTAL_LOAD = "total_load"
GRID_REFERENCE = "grid_reference_smard"
MARKET_PRICE = "smard_market_price"
MARKET_PRICE_UNIT = "eur/mwh"

# At most this many ids are written into a plan as literals.
LITERAL_IDS = 1000


def named(identifier: str) -> Column:
    """Series with this identifier, in any case."""
    return key("identifier") == F.lit(identifier)


def any_producer() -> Column:
    return F.col("consumption") == F.lit(False)


def local_producer() -> Column:
    return any_producer() & (F.col("local") == F.lit(True))


def local_consumer() -> Column:
    """Local consumers without the two series that already are totals."""
    return (
        (F.col("consumption") == F.lit(True))
        & (F.col("local") == F.lit(True))
        & ~key("identifier").isin(TOTAL_LOAD, GRID_REFERENCE)
    )


def grid_mix() -> Column:
    """Production of the surrounding grid by carrier."""
    return (F.col("consumption") == F.lit(True)) & (F.col("local") == F.lit(False))


@dataclass(frozen=True)
class SeriesSet:
    """Registry rows of chosen series; ``ids`` are known if there are few of them."""

    frame: DataFrame
    ids: list[int] | None

    @property
    def bounded(self) -> bool:
        return self.ids is not None

    def describe(self, df: DataFrame) -> DataFrame:
        """Add the registry columns to rows keyed by ``meta_id``."""
        frame = self.frame.withColumnRenamed("id", "meta_id")
        frame = F.broadcast(frame) if self.bounded else frame
        return df.join(frame, "meta_id")


def choose(t: Tables, role: Column, *columns: Column | str) -> SeriesSet:
    """The series for which ``role`` holds, with id and the given registry columns."""
    frame = t.meta.filter(role).select("id", *columns)
    rows = frame.select("id").limit(LITERAL_IDS + 1).collect()
    ids = [row.id for row in rows] if len(rows) <= LITERAL_IDS else None
    return SeriesSet(frame, ids)


def choose_with_carrier(t: Tables, role: Column, *columns: Column | str) -> SeriesSet:
    """As ``choose``, without series that have no carrier; adds carrier id and name."""
    carriers = t.carriers.select(F.col("id").alias("carrier"), F.col("name").alias("carrier_name"))
    chosen = choose(t, role & F.col("carrier").isNotNull(), "carrier", *columns)
    return SeriesSet(chosen.frame.join(carriers, "carrier"), chosen.ids)


def in_range(ts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Samples in the closed range; names the month partition too where there is one."""
    data_type = ts.schema["series_timestamp"].dataType
    if "month" in ts.columns:
        months = [F.lit(f"{m.year:04}-{m.month:02}-01").cast("date") for m in (start, end)]
        ts = ts.filter(F.col("month").between(*months))
    return ts.filter(
        F.col("series_timestamp").between(instant(start, data_type), instant(end, data_type))
    )


def samples_of(t: Tables, series: SeriesSet, start: datetime, end: datetime) -> DataFrame:
    """(meta_id, series_timestamp, series_value) of the chosen series in the range."""
    return of_series(in_range(t.ts, start, end).select("meta_id", "series_timestamp", "series_value"), series)


def of_series(rows: DataFrame, series: SeriesSet) -> DataFrame:
    """Rows of the chosen series: few become a literal filter that reaches the scan, more a semi join."""
    if series.bounded:
        return rows.filter(F.col("meta_id").isin(series.ids))
    ids = series.frame.select(F.col("id").alias("meta_id"))
    return rows.join(ids, "meta_id", "left_semi")
