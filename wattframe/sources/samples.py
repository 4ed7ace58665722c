"""The sample table: uniqueness, append, read."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from wattframe.functions.instants import EPOCH, require_utc
from wattframe.functions.sizes import drop_folder, shared_folder, staged
from wattframe.operators.series import in_range
from wattframe.sources.extents import append_extents
from wattframe.tables import SAMPLE_SCHEMA

KEYS = ["meta_id", "series_timestamp"]

# At most this many months or series are written into a plan as literals.
LITERALS = 1000
STORED_SCHEMA = T.StructType([*SAMPLE_SCHEMA.fields, T.StructField("month", T.DateType())])


class DuplicateSamples(ValueError):
    """A batch repeats a (series, timestamp) that the table already holds."""


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The stored sample table, partitioned by month; empty if nothing was written yet."""
    require_utc(spark)
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def has_samples(ts: DataFrame) -> bool:
    """Whether the table holds anything; initial loads only run on an empty one."""
    return not ts.limit(1).isEmpty()


def month_of(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def touched_rows(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows a batch may clash with, so that other months and series are not read.

    A late sample among recent ones touches two months, not the years between them.
    """
    micros = F.unix_micros(F.col("series_timestamp").cast("timestamp"))
    spans = batch.groupBy(month_of("series_timestamp").alias("month")).agg(
        F.min(micros).alias("first"), F.max(micros).alias("last")
    )
    months = spans.limit(LITERALS + 1).collect()
    ids = batch.select("meta_id").distinct().limit(LITERALS + 1).collect()
    if not months:
        return existing.limit(0)
    if len(months) <= LITERALS:
        first, last = min(m["first"] for m in months), max(m["last"] for m in months)
        span = [EPOCH + timedelta(microseconds=end) for end in (first, last)]
        existing = in_range(existing, *span).filter(F.col("month").isin([m.month for m in months]))
    if len(ids) <= LITERALS:
        existing = existing.filter(F.col("meta_id").isin([row.meta_id for row in ids]))
    return existing


def duplicate_samples(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Keys that break uniqueness: (meta_id, series_timestamp, copies, stored).

    ``copies`` counts the rows of the batch, ``stored`` tells whether the table has the
    key. Rows without a series never clash.
    """
    keys = batch.select(*KEYS).filter(F.col("meta_id").isNotNull())
    copies = keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
    clashes = (
        existing.select(*KEYS)
        .join(copies.select(*KEYS), KEYS, "left_semi")
        .distinct()
        .withColumn("stored", F.lit(True))
    )
    return (
        copies.join(clashes, KEYS, "left")
        .withColumn("stored", F.coalesce("stored", F.lit(False)))
        .filter((F.col("copies") > 1) | F.col("stored"))
    )


def new_samples(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per key of ``batch`` that ``existing`` lacks; of copies the lowest value."""
    single = batch.groupBy(*KEYS).agg(F.min("series_value").alias("series_value"))
    return single.join(existing.select(*KEYS), KEYS, "left_anti")


def stored_form(batch: DataFrame) -> DataFrame:
    """Samples in table form, range-partitioned and sorted by month, series and time.

    Ranges split a long series or a full month over many tasks and files, and make the
    files skippable by series and time. Equal keys meet in one range, so repeated keys
    are found on the way: the second copy fails the job and nothing is committed, and so
    does a row without series or time, which no query could read. The id is a hash of the
    key, the same on every run; with the timestamp it is unique.
    """
    order = ["month", *KEYS]
    rows = batch.select(*KEYS, "series_value").withColumn("month", month_of("series_timestamp"))
    copy = F.row_number().over(Window.partitionBy(*order).orderBy("series_value"))
    message = F.format_string("repeated sample: series %s at %s", *KEYS)
    lacking = F.col("meta_id").isNull() | F.col("series_timestamp").isNull()
    value = (
        F.when(lacking, F.raise_error(F.lit("sample without a series or a time")))
        .when(F.col("copy") > 1, F.raise_error(message))
        .otherwise(F.col("series_value"))
    )
    ranges = rows.repartitionByRange(*order)
    return (
        ranges.withColumn("copy", copy)
        .select(
            F.xxhash64(*KEYS).alias("id"),
            "series_timestamp",
            value.alias("series_value"),
            "meta_id",
            F.current_timestamp().alias("created_at"),
            F.current_timestamp().alias("updated_at"),
            "month",
        )
    )


def append_samples(
    batch: DataFrame, path: str, on_duplicate: str = "error", extents: str | None = None
) -> None:
    """Append (meta_id, series_timestamp, series_value) rows to the table at ``path``.

    ``error`` refuses the whole batch if a key is repeated or already stored, ``skip``
    appends the rows that are new. The batch is written to the shared folder first, so that
    it is computed once and its size is known, and removed in the end. Keys are checked before
    they are written, so a table may have one writer at a time only. With ``extents``, a path,
    the first and last times of the batch are added there once its samples are stored.
    """
    if on_duplicate not in ("error", "skip"):
        raise ValueError(f"unknown duplicate handling: {on_duplicate!r}")
    spark = batch.sparkSession
    place = shared_folder(spark, "batch")
    try:
        batch = staged_rows = staged(batch.select(*KEYS, "series_value"), place)
        existing = read_samples(spark, path)
        stored = has_samples(existing)
        if stored:
            existing = touched_rows(existing, batch)
        if on_duplicate == "skip":
            batch = new_samples(batch, existing)
        elif stored:
            clash = existing.select(*KEYS).join(batch.select(*KEYS), KEYS, "left_semi").first()
            if clash is not None:
                raise DuplicateSamples(
                    f"already stored: series {clash.meta_id} at {clash.series_timestamp}"
                )
        stored_form(batch).write.mode("append").partitionBy("month").parquet(path)
        if extents is not None:  # skipped samples lie within the extents that are stored
            append_extents(staged_rows, extents)
    finally:
        drop_folder(spark, place)


def unnest_samples(
    df: DataFrame, timestamps: str = "timestamps", values: str = "values", ids: str = "meta_ids"
) -> DataFrame:
    """Rows of samples from parallel arrays; shorter arrays are padded with NULL."""
    zipped = F.arrays_zip(
        F.col(timestamps).alias("series_timestamp"),
        F.col(values).alias("series_value"),
        F.col(ids).alias("meta_id"),
    )
    return df.select(F.explode(zipped).alias("row")).select(
        F.col("row")["series_timestamp"].alias("series_timestamp"),
        F.col("row")["series_value"].alias("series_value"),
        F.col("row")["meta_id"].alias("meta_id"),
    )
