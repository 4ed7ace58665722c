"""Emission factors: averages, additions, listing and choice of source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wattframe.functions.sizes import shared_folder, staged
from wattframe.operators.numbering import with_next_ids
from wattframe.tables import DEFAULT_SOURCE, FACTOR_SCHEMA, FACTOR_UNIT, Tables

AUDIT = ["created_at", "updated_at"]
STORED_SCHEMA = T.StructType([*FACTOR_SCHEMA.fields, *(T.StructField(c, T.TimestampType()) for c in AUDIT)])

# Carriers without a factor of their own and the carriers they average.
CONVENTIONAL = ["gas", "lignite", "coal", "nuclear"]
RENEWABLE = ["solar", "hydro", "biomass", "biogas", "onwind", "offwind"]
AVERAGES = {
    "other_conventional": CONVENTIONAL,
    "other_renewable": RENEWABLE,
    "pumped_storage": RENEWABLE,
}


def _carrier_names(carriers: DataFrame) -> DataFrame:
    return carriers.select(F.col("id").alias("carrier"), F.col("name").alias("carrier_name"))


def average_factors(factors: DataFrame, carriers: DataFrame) -> DataFrame:
    """New factor rows for the carriers of ``AVERAGES``, without ids: carrier, factor, .."""
    means = factors.join(_carrier_names(carriers), "carrier").agg(
        *(
            F.avg(F.when(F.col("carrier_name").isin(members), F.col("factor"))).alias(name)
            for name, members in AVERAGES.items()
        )
    )
    return (
        means.unpivot([], list(AVERAGES), "carrier_name", "factor")
        .join(_carrier_names(carriers), "carrier_name")
        .select(
            "carrier",
            "carrier_name",
            "factor",
            F.lit(FACTOR_UNIT).alias("unit"),
            F.lit(DEFAULT_SOURCE).alias("source"),
            F.lit(None).cast("string").alias("source_url"),
        )
    )


def new_factors(requests: DataFrame, factors: DataFrame, carriers: DataFrame) -> DataFrame:
    """Factor rows to append for requests (carrier name, factor, unit, source, source_url).

    Requests that name an unknown carrier yield no row, see ``rejected_factors``.
    """
    named = requests.withColumnRenamed("carrier", "carrier_name")
    rows = named.join(_carrier_names(carriers), "carrier_name")
    rows = rows.select("carrier", "factor", "unit", "source", "source_url")
    return with_next_ids(rows, factors)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """The stored factors with their audit columns; empty if nothing was written yet."""
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def append_factors(requests: DataFrame, path: str, carriers: DataFrame) -> DataFrame:
    """Append the factors of ``requests`` and return the rows written.

    Nothing is written if a carrier is unknown. One writer at a time.
    """
    spark = requests.sparkSession
    bad = rejected_factors(requests, carriers).first()
    if bad is not None:
        raise ValueError(f"unknown carrier: {bad.carrier}")
    now = F.current_timestamp()
    rows = new_factors(requests, read_factors(spark, path), carriers).withColumns(dict.fromkeys(AUDIT, now))
    rows = staged(rows.select(*STORED_SCHEMA.names), shared_folder(spark, "factors"))
    rows.write.mode("append").parquet(path)
    return rows


def rejected_factors(requests: DataFrame, carriers: DataFrame) -> DataFrame:
    """Requests whose carrier is not registered."""
    names = carriers.select(F.col("name").alias("carrier"))
    return requests.join(names, "carrier", "left_anti")


def list_factors(t: Tables, source: str | None = None, carrier: str | None = None) -> DataFrame:
    """Factors with carrier names, optionally of one source or one carrier."""
    factors = t.factors if source is None else t.factors.filter(F.col("source") == source)
    listed = factors.join(_carrier_names(t.carriers), "carrier")
    if carrier is not None:
        listed = listed.filter(F.col("carrier_name") == carrier)
    extra = [c for c in ("created_at", "updated_at") if c in factors.columns]
    return listed.select(
        "id", F.col("carrier_name").alias("carrier"), "unit", "factor", "source", "source_url", *extra
    )


def source_or_default(t: Tables, source: str) -> str:
    """``source`` if any factor has it, else the default source."""
    known = not t.factors.filter(F.col("source") == source).limit(1).isEmpty()
    return source if known else DEFAULT_SOURCE


def resolve_sources(requests: DataFrame, factors: DataFrame, source: str = "source") -> DataFrame:
    """Add ``used_source`` to many requests at once, by the rule of ``source_or_default``."""
    known = factors.select(F.col("source").alias("used_source")).distinct()
    return requests.join(known, F.col(source) == F.col("used_source"), "left").withColumn(
        "used_source", F.coalesce("used_source", F.lit(DEFAULT_SOURCE))
    )


def factors_of(t: Tables, source: str) -> DataFrame:
    """(carrier, factor) rows of the source, or of the default if it is unknown."""
    used = source_or_default(t, source)
    return t.factors.filter(F.col("source") == used).select("carrier", "factor")
