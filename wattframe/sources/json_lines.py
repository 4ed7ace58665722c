"""Results as JSON with RFC 3339 timestamps, as lines or as one nested document in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.functions.instants import RFC_3339_FORMAT

# Timestamps without a zone are UTC here, so they get a literal Z.
NTZ_FORMAT = RFC_3339_FORMAT.replace("XXX", "'Z'")
OPTIONS = {
    "timestampFormat": RFC_3339_FORMAT,
    "timestampNTZFormat": NTZ_FORMAT,
    "ignoreNullFields": "false",
}


def as_json(df: DataFrame) -> Column:
    """One JSON object per row, as a column of ``df``."""
    return F.to_json(F.struct(*df.columns), OPTIONS)


def write_json(df: DataFrame, path: str) -> None:
    """Write a result as JSON lines; rows stay distributed over files."""
    df.write.options(**OPTIONS).json(path)


def document_lines(datapoints: DataFrame, meta: DataFrame, order: str) -> DataFrame:
    """(rank, at, line) of the document ``{"datapoints": [..], "meta": {..}}``, in no order.

    Lines by rank and ``at`` make the document. The last datapoint alone has no comma behind
    it; it is told by its place, a single value. ``order`` must be different in all rows.
    """
    last = datapoints.agg(F.max(order)).first()[0]
    at = F.col(order)
    body = datapoints.select(
        F.lit(1).alias("rank"),
        at.alias("at"),
        F.concat(as_json(datapoints), F.when(at == F.lit(last), "").otherwise(",")).alias("line"),
    )
    ends = meta.limit(1).select(F.explode(F.array(F.lit(0), F.lit(2))).alias("rank"), as_json(meta).alias("meta"))
    closing = F.concat(F.lit('],"meta":'), "meta", F.lit("}"))
    none = F.lit(None).cast(datapoints.schema[order].dataType)
    line = F.when(F.col("rank") == 0, '{"datapoints":[').otherwise(closing)
    return body.unionByName(ends.select("rank", none.alias("at"), line.alias("line")))


def write_document(datapoints: DataFrame, meta: DataFrame, path: str, order: str = "timestamp") -> None:
    """Write a series and its registry row as one nested JSON document, in parts.

    The files below ``path``, one after the other by name, are the document, so no task
    writes more than its range. A series without datapoints has an empty list.
    """
    lines = document_lines(datapoints, meta, order)
    lines.repartitionByRange("rank", "at").sortWithinPartitions("rank", "at").select("line").write.text(path)


def read_document(spark: SparkSession, path: str, datapoints: str) -> DataFrame:
    """The datapoints of a written document, by their schema; lines are read by many tasks."""
    lines = spark.read.text(path).filter(~F.col("value").startswith('{"datapoints":[') & ~F.col("value").startswith("]"))
    text = F.regexp_replace("value", ",$", "")
    return lines.select(F.from_json(text, datapoints, {**OPTIONS, "mode": "FAILFAST"}).alias("row")).select("row.*")
