"""Registering series.

Inputs are rows (identifier, unit, carrier name, consumption, description, local, position);
the position is the place in the list they were sent in, and gives new ids their order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from wattframe.functions.sizes import shared_folder, staged
from wattframe.functions.text import key
from wattframe.operators.numbering import with_next_ids
from wattframe.tables import META_SCHEMA, local_table

INPUT_SCHEMA = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("carrier", T.StringType()),
        T.StructField("consumption", T.BooleanType()),
        T.StructField("description", T.StringType()),
        T.StructField("local", T.BooleanType()),
        T.StructField("position", T.LongType()),
    ]
)
REQUIRED_ON_IMPORT = ["carrier", "consumption", "description"]
AUDIT = ["created_at", "updated_at"]
# Ids per row of the page directory.
PAGE_RANGE = 4096
STORED_SCHEMA = T.StructType([*META_SCHEMA.fields, *(T.StructField(c, T.TimestampType()) for c in AUDIT)])


class RefusedSeries(ValueError):
    """Series that are registered already, or sent twice."""


def series_inputs(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Series definitions of an import spec or request as a table."""
    attributes = INPUT_SCHEMA.names[:-1]
    unknown = {name for entry in entries for name in entry} - set(attributes)
    if unknown:
        raise ValueError(f"unknown series attributes: {sorted(unknown)}")
    for entry in entries:
        if not (isinstance(entry.get("identifier"), str) and isinstance(entry.get("unit"), str)):
            raise ValueError(f"identifier and unit are required: {entry}")
        if not isinstance(entry.get("carrier"), (str, type(None))):
            raise ValueError(f"carrier must be a name: {entry}")
    rows = [(*(entry.get(name) for name in attributes), i) for i, entry in enumerate(entries)]
    return local_table(spark, rows, INPUT_SCHEMA)


def _by_name(carriers: DataFrame) -> DataFrame:
    return carriers.select(F.col("id").alias("carrier_id"), F.col("name").alias("carrier"))


def normalised(inputs: DataFrame) -> DataFrame:
    """Import rules: lower-case keys, ``local`` false by default, other attributes required."""
    missing = F.array_compact(
        F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_ON_IMPORT))
    )
    checked = F.when(
        F.size(missing) > 0,
        F.raise_error(F.format_string("series %s lacks %s", "identifier", F.array_join(missing, ", "))),
    ).otherwise(F.lower("identifier"))
    return inputs.withColumns(
        {
            "identifier": checked,
            "unit": F.lower("unit"),
            "local": F.coalesce("local", F.lit(False)),
        }
    )


def new_series(inputs: DataFrame, meta: DataFrame, carriers: DataFrame) -> DataFrame:
    """Registry rows that importing normalised ``inputs`` adds.

    Known (identifier, unit) pairs and unknown carriers add nothing. Of several inputs
    for one pair the first listed is kept; ids follow the list.
    """
    known = meta.select(key("identifier").alias("_i"), key("unit").alias("_u"))
    attributes = ["identifier", "unit", "carrier_id", "consumption", "description", "local"]
    first = (
        inputs.join(_by_name(carriers), "carrier")
        .groupBy(key("identifier").alias("_i"), key("unit").alias("_u"))
        .agg(
            F.min_by(F.struct(*attributes), F.struct("position", *attributes)).alias("row"),
            F.min("position").alias("position"),
        )
    )
    rows = first.join(known, ["_i", "_u"], "left_anti").select(
        "row.identifier",
        "row.unit",
        F.col("row.carrier_id").alias("carrier"),
        "row.consumption",
        "row.description",
        "row.local",
        F.lit(0).alias("microgrid_id"),
        "position",
    )
    return with_next_ids(rows, meta, "position", "identifier", "unit").drop("position")


def resolved(inputs: DataFrame, meta: DataFrame) -> DataFrame:
    """``inputs`` with the ``meta_id`` of their registry row, NULL where there is none."""
    ids = meta.filter(F.col("carrier").isNotNull()).select(
        F.col("id").alias("meta_id"), key("identifier").alias("_i"), key("unit").alias("_u")
    )
    keyed = inputs.withColumns({"_i": key("identifier"), "_u": key("unit")})
    return keyed.join(ids, ["_i", "_u"], "left").drop("_i", "_u")


def registered_series(inputs: DataFrame, meta: DataFrame, carriers: DataFrame) -> DataFrame:
    """The registry after importing ``inputs``: every known row and the new ones."""
    columns = [c for c in meta.columns if c not in AUDIT]
    return meta.select(*columns).unionByName(new_series(normalised(inputs), meta, carriers))


def added_series(inputs: DataFrame, meta: DataFrame, carriers: DataFrame) -> DataFrame:
    """Registry rows for ``inputs`` sent to the registry directly.

    Keys keep their case; an unknown carrier is stored as NULL while ``carrier_name``
    echoes the request. Pairs that are registered, or sent twice, are refused when the
    rows are written, see ``append_series``.
    """
    rows = inputs.join(_by_name(carriers), "carrier", "left").select(
        "identifier",
        "unit",
        F.col("carrier_id").alias("carrier"),
        "consumption",
        "description",
        "local",
        F.lit(0).alias("microgrid_id"),
        F.col("carrier").alias("carrier_name"),
        "position",
    )
    return with_next_ids(rows, meta, "position", "identifier", "unit").drop("position")


def refused_series(inputs: DataFrame, meta: DataFrame) -> DataFrame:
    """(identifier, unit) pairs that break the uniqueness of the registry, in lower case."""
    sent = inputs.select(F.lower("identifier").alias("identifier"), F.lower("unit").alias("unit"))
    held = meta.select(F.lower("identifier").alias("identifier"), F.lower("unit").alias("unit"))
    counted = sent.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
    return (
        counted.groupBy(key("identifier").alias("_i"), key("unit").alias("_u"))
        .agg(
            F.min("identifier").alias("identifier"),
            F.min("unit").alias("unit"),
            F.count(F.when(~F.col("held"), 1)).alias("sent"),
            F.count(F.when(F.col("held"), 1)).alias("held"),
        )
        .filter((F.col("sent") > 1) | ((F.col("sent") > 0) & (F.col("held") > 0)))
        .select("identifier", "unit", "sent", "held")
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The stored registry with its audit columns; empty if nothing was written yet."""
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def known_series(meta: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored registry rows and those of ``meta`` whose series is not stored.

    A row of ``meta`` with an id that is stored for another series is refused.
    """
    columns = META_SCHEMA.names
    pair = lambda df: df.withColumns({"_i": key("identifier"), "_u": key("unit")})
    rest = pair(meta.select(*columns)).join(pair(stored).select("_i", "_u"), ["_i", "_u"], "left_anti")
    clash = rest.join(stored.select("id"), "id", "left_semi").first()
    if clash is not None:
        raise RefusedSeries(f"id {clash.id} of {clash.identifier} is stored for another series")
    return stored.select(*columns).unionByName(rest.select(*columns))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append registry rows as they are, stamped with the current time."""
    now = F.current_timestamp()
    stamped = rows.select(*META_SCHEMA.names, *(now.alias(c) for c in AUDIT))
    stamped.write.mode("append").parquet(path)


def append_series(inputs: DataFrame, path: str, carriers: DataFrame) -> DataFrame:
    """Append ``inputs`` sent to the registry directly and return the rows written.

    Nothing is written if a pair is registered already or sent twice. One writer at a time.
    """
    spark = inputs.sparkSession
    meta = read_registry(spark, path)
    refused = refused_series(inputs, meta).first()
    if refused is not None:
        raise RefusedSeries(f"already registered or sent twice: {refused.identifier} in {refused.unit}")
    rows = staged(added_series(inputs, meta, carriers), shared_folder(spark, "series"))
    append_rows(rows, path)
    return rows


def page_directory(meta: DataFrame, width: int = PAGE_RANGE) -> DataFrame:
    """Where pages of the registry lie: (low, high, rows, before) per range of ``width`` ids.

    ``before`` counts the rows of all lower ranges. One row per range that has ids, made by
    one task from counts that were summed up first; to be stored, and made anew after
    series were added.
    """
    ranges = meta.groupBy(F.floor(F.col("id") / width).alias("range")).agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.filter(F.col("range").isNotNull()).select(
        "low", "high", "rows", F.coalesce(F.sum("rows").over(lower), F.lit(0)).alias("before")
    )


def page_rows(meta: DataFrame, directory: DataFrame, skipped: int, count: int) -> tuple[DataFrame, int]:
    """Registry rows of the ranges that hold a page, and how many of them lie before it."""
    here = directory.filter((F.col("before") < skipped + count) & (F.col("before") + F.col("rows") > skipped))
    span = here.agg(F.min("low"), F.max("high"), F.min("before")).first()
    if span[0] is None:
        return meta.limit(0), 0
    return meta.filter(F.col("id").between(span[0], span[1])), max(skipped - span[2], 0)
