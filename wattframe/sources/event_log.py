"""An event log (event_id, ts, user_id, value, ..) read as meter samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.operators.series import MARKET_PRICE, MARKET_PRICE_UNIT
from wattframe.tables import CARRIER_NAMES, META_SCHEMA, Tables, local_table
from wattframe.tables import seed_carriers, seed_factors

# The sample registry in id order, counted from 1, as
# identifier, unit, consumption, local, carrier.
SAMPLE_SERIES = [
    ("evse_cluster", "kw", True, True, "electricity"),
    ("haus_harbig", "kw", True, True, "electricity"),
    ("haus_fleming", "kw", True, True, "electricity"),
    ("production_of_chp", "kw", False, True, "biogas"),
    ("total_load", "kw", True, True, "electricity"),
    ("grid_reference_smard", "kw", True, True, "electricity"),
    ("production_of_pv", "kw", False, True, "solar"),
    ("brown coal", "mwh", True, False, "lignite"),
    ("hard coal", "mwh", True, False, "coal"),
    ("other conventional fuel", "mwh", True, False, "other_conventional"),
    ("natural gas", "mwh", True, False, "gas"),
    ("biomass", "mwh", True, False, "biomass"),
    ("hydropower", "mwh", True, False, "hydro"),
    ("windoffshore", "mwh", True, False, "offwind"),
    ("windonshore", "mwh", True, False, "onwind"),
    ("photovoltaic", "mwh", True, False, "solar"),
    ("other renewables", "mwh", True, False, "other_renewable"),
    ("pumped storage", "mwh", True, False, "pumped_storage"),
    ("trafo_out_1_power_watts_15_min_mean", "w", True, True, "electricity"),
    ("trafo_out_2_power_watts_15_min_mean", "w", True, True, "electricity"),
    (MARKET_PRICE, MARKET_PRICE_UNIT, None, None, None),
]
# Power series, whose values are lowered so that some become negative.
POWER_IDS = [1, 2, 3, 4, 5, 6, 7, 19, 20]
POWER_SHIFT = 5.0


def sample_registry(spark: SparkSession) -> DataFrame:
    rows = [
        (i, name, unit, carrier and CARRIER_NAMES.index(carrier) + 1, consumption, name, local, 0)
        for i, (name, unit, consumption, local, carrier) in enumerate(SAMPLE_SERIES, start=1)
    ]
    return local_table(spark, rows, META_SCHEMA)


def series_of_event() -> Column:
    """The series an event belongs to."""
    return ((F.col("event_id") + F.col("user_id")) % len(SAMPLE_SERIES) + 1).cast("int")


def event_samples(events: DataFrame) -> DataFrame:
    """Every event as one sample; the audit columns repeat the event time."""
    shifted = F.when(F.col("meta_id").isin(POWER_IDS), F.col("value") - POWER_SHIFT)
    return events.withColumn("meta_id", series_of_event()).select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("series_timestamp"),
        shifted.otherwise(F.col("value")).alias("series_value"),
        "meta_id",
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def event_tables(spark: SparkSession, folder: str, weighting: str = "chunked") -> Tables:
    """All four tables, with the samples taken from ``events.parquet`` in ``folder``."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return Tables(
        event_samples(events),
        sample_registry(spark),
        seed_carriers(spark),
        seed_factors(spark),
        weighting,
    )
