"""Point feeds: JSON bodies ``{"timeseries": [{timestamp, value, identifier}, ..]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.functions.instants import RFC_3339
from wattframe.sources.records import records, unescaped_quote_count

BODY_SCHEMA = "timeseries array<struct<timestamp: string, value: double, identifier: string>>"


def read_bodies(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed request bodies: one JSON document per file, or one per line.

    Files of lines are split over tasks; a document of its own is one row in one task, see
    ``split_bodies`` for large ones.
    """
    return spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "body")


# A body up to its first point, what lies between points, and what ends a body.
OPENING = r'^\s*\{\s*"timeseries"\s*:\s*\[\s*'
BETWEEN = r"^\s*,\s*"
CLOSING = r"^\s*\]\s*$"


def split_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one per file, as bodies of a single point each; any size of file.

    A document is read by many tasks, cut behind each ``}`` outside quotes. It must have the
    form ``{"timeseries": [..]}`` with flat points; another form, or one that is broken
    anywhere, fails the job. ``read_bodies`` takes any form, a document in one task.
    """
    # Every piece but the last has lost the brace that ended it.
    pieces = records(spark, path, "}", unescaped_quote_count)
    place = F.struct("range", "place")
    kind = (
        F.when(F.col("first") & F.col("record").rlike(OPENING + r"\{"), "point")
        .when(F.col("first") & F.col("record").rlike(OPENING + r"\]\s*$"), "end")
        .when(~F.col("first") & F.col("record").rlike(BETWEEN + r"\{"), "point")
        .when(~F.col("first") & F.col("record").rlike(CLOSING), "end")
        .when(~F.col("first") & (F.trim(F.regexp_replace("record", r"\s", "")) == ""), "rest")
        .otherwise("other")
    )
    pieces = pieces.withColumn("kind", kind)
    files = pieces.groupBy("file").agg(
        F.count(F.when(F.col("kind") == "end", 1)).alias("ends"),
        F.count(F.when(F.col("kind") == "other", 1)).alias("others"),
        F.count(F.when(F.col("first"), 1)).alias("firsts"),
        F.max(F.when(F.col("kind") == "point", place)).alias("last_point"),
        F.max(F.when(F.col("kind") == "end", place)).alias("end"),
        F.min(F.when(F.col("kind") == "rest", place)).alias("rest"),
        F.count(F.when(F.col("kind") == "rest", 1)).alias("rests"),
        (F.sum(F.octet_length("record") + 1) - F.max("size")).alias("unended"),  # pieces without a brace behind
    )
    whole = (F.col("ends") == 1) & (F.col("others") == 0) & (F.col("firsts") == 1)
    whole &= F.coalesce(F.col("last_point") < F.col("end"), F.lit(True))
    whole &= F.coalesce(F.col("rest") > F.col("end"), F.lit(True))
    whole &= (F.col("rests") <= 1) & (F.col("unended") == F.col("rests"))
    files = files.select(F.col("file").alias("of"), F.coalesce(whole, F.lit(False)).alias("whole"))
    rows = pieces.join(files, F.col("file") == F.col("of"))
    point = F.regexp_replace(F.regexp_replace("record", OPENING, ""), BETWEEN, "")
    body = F.concat(F.lit('{"timeseries":['), point, F.lit("}]}"))
    broken = F.raise_error(F.format_string("not a body of flat points: %s", "file")).cast("string")
    # Exploded, not filtered: a filter may be merged with later ones that parse what isn't a point.
    bodies = F.when(~F.col("whole"), F.array(broken)).when(F.col("kind") == "point", F.array(body))
    return rows.select(F.explode(bodies).alias("body"))


def parse_points(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(series_timestamp, series_value, identifier) of every point.

    A body that is no JSON, lacks a key or has a timestamp that is not RFC 3339 fails
    the job, as it would be refused as a whole.
    """
    parsed = F.from_json(F.col(body), BODY_SCHEMA, {"mode": "FAILFAST"})["timeseries"]
    points = bodies.select(
        F.when(parsed.isNull(), F.raise_error(F.lit("body without timeseries")))
        .otherwise(parsed)
        .alias("points")
    ).select(F.inline("points"))
    timestamp = F.col("timestamp")
    complete = (
        timestamp.rlike(f"^{RFC_3339.pattern}$")
        & F.col("value").isNotNull()
        & F.col("identifier").isNotNull()
    )
    bad = F.raise_error(F.concat(F.lit("incomplete point: "), F.to_json(F.struct("*"))))
    return points.select(
        F.when(F.coalesce(complete, F.lit(False)), timestamp.cast("timestamp"))
        .otherwise(bad)
        .alias("series_timestamp"),
        F.col("value").alias("series_value"),
        "identifier",
    )


def resolve_points(points: DataFrame, meta: DataFrame) -> DataFrame:
    """(meta_id, series_timestamp, series_value); unregistered identifiers are left out.

    Identifiers must match in case. Of several units the lowest series id counts.
    """
    ids = meta.groupBy("identifier").agg(F.min("id").alias("meta_id"))
    return points.join(ids, "identifier").select(
        "meta_id", "series_timestamp", "series_value"
    )
