"""Ids for appended rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattframe.functions.sizes import shared_folder, staged


def with_next_ids(rows: DataFrame, existing: DataFrame, *order: str) -> DataFrame:
    """Put ids after the highest existing one in front of ``rows``, in ``order``.

    One rule for any size: a row's id follows from its place in the order of the columns
    (all of them by default), whatever the number of rows or partitions. Rows are ranged by
    the order and written once, numbered within their range, and shifted by the sizes of the
    ranges before; equal rows may be split over ranges. One row per range passes one task.
    """
    columns = rows.columns
    order = order or tuple(columns)
    id_type = existing.schema["id"].dataType
    highest = existing.agg(F.max("id")).first()[0] or 0
    split = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = split.repartitionByRange(*order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, shared_folder(rows.sparkSession, "numbered"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    shifts = shifts.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    # as many shifts as ranges, which the session bounds
    numbered = ranged.withColumn("_place", place).join(F.broadcast(shifts), "_range")
    number = F.col("_place") + F.col("_shift") + F.lit(highest)
    return numbered.select(number.cast(id_type).alias("id"), *columns)
