"""The four tables every query reads, their schemas and their seed rows."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

# Energy carriers in id order, counted from 1.
CARRIER_NAMES = [
    "coal",
    "lignite",
    "oil",
    "gas",
    "nuclear",
    "solar",
    "hydro",
    "biomass",
    "biogas",
    "onwind",
    "offwind",
    "electricity",
    "pumped_storage",
    "other_renewable",
    "other_conventional",
]

# Default emission factors by carrier, in id order. The last three are
# the averages that operators.factors.average_factors computes from the others.
FACTOR_UNIT = "kgco2eq/kwh"
DEFAULT_SOURCE = "IPCC"
CARRIER_FACTORS = {
    "lignite": 0.82,
    "gas": 0.49,
    "coal": 0.82,
    "hydro": 0.024,
    "solar": 0.048,
    "nuclear": 0.012,
    "onwind": 0.011,
    "offwind": 0.012,
    "biomass": 0.230,
    "biogas": 0.230,
}
AVERAGED_FACTORS = {
    "other_conventional": 0.5355,
    "other_renewable": 0.0925,
    "pumped_storage": 0.0925,
}

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("series_timestamp", T.TimestampType()),
        T.StructField("series_value", T.DoubleType()),
        T.StructField("meta_id", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
META_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("carrier", T.IntegerType()),
        T.StructField("consumption", T.BooleanType()),
        T.StructField("description", T.StringType()),
        T.StructField("local", T.BooleanType()),
        T.StructField("microgrid_id", T.IntegerType()),
    ]
)
CARRIER_SCHEMA = T.StructType(
    [T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]
)
FACTOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("carrier", T.IntegerType()),
        T.StructField("factor", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Tables:
    """Samples (``ts``), series registry (``meta``), energy carriers, emission factors.

    ``ts`` holds one row per sample and is the only large table. ``weighting`` and
    ``chunk`` choose how sample weights are computed, see operators.weights. Three tables are
    optional and spare reading samples: their extents by series and month (sources.extents),
    a page directory of the registry (sources.registry) and hourly sums (sources.hourly).
    """

    ts: DataFrame
    meta: DataFrame
    carriers: DataFrame
    factors: DataFrame
    weighting: str = "chunked"
    chunk: str = "1hour"
    extents: DataFrame | None = None
    pages: DataFrame | None = None
    hourly: DataFrame | None = None


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A literal table kept in the JVM plan, so that Spark knows its size."""
    columns = zip(*rows) if rows else ([] for _ in schema)
    arrow_types = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(),
        T.TimestampType(): pa.timestamp("us", tz="UTC"),
        T.TimestampNTZType(): pa.timestamp("us"),
    }
    arrays = [
        pa.array(list(values), arrow_types[field.dataType])
        for values, field in zip(columns, schema)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def seed_carriers(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(enumerate(CARRIER_NAMES, start=1)), CARRIER_SCHEMA)


def seed_factors(spark: SparkSession, averaged: bool = True) -> DataFrame:
    """Default emission factors; ``averaged=False`` leaves out the derived ones."""
    known = CARRIER_FACTORS | (AVERAGED_FACTORS if averaged else {})
    rows = [
        (i, CARRIER_NAMES.index(name) + 1, factor, FACTOR_UNIT, DEFAULT_SOURCE, None)
        for i, (name, factor) in enumerate(known.items(), start=1)
    ]
    return local_table(spark, rows, FACTOR_SCHEMA)
