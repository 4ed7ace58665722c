"""Continuous sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wattframe.functions.intervals import parse_interval
from wattframe.functions.sizes import broadcast_if_few, drop_folder
from wattframe.operators.weights import MAX_HOURS, hours_of, sample_neighbours
from wattframe.streaming.log import only_log, own_log

WEIGHED = "meta_id int, series_timestamp timestamp, series_value double, hours double, late boolean"
STATE = "meta_id int, series_timestamp timestamp, series_value double, hours double, kind string"
COLUMNS = ["meta_id", "series_timestamp", "series_value"]


def weigh_stream(
    samples: DataFrame, path: str, checkpoint: str, delay: str = "1day", chunk: str = "1hour"
) -> StreamingQuery:
    """Log the weight of every sample as soon as its predecessor is certain.

    Samples (meta_id, series_timestamp, series_value) may come in any order within ``delay``:
    a sample is weighed once its series has one that is newer by the delay, for then nothing
    may come before it any more; the first of a series also needs its successor, or a quarter
    of an hour. What comes later than that is logged with NULL hours and ``late``, never
    dropped; its month is then to be weighed by ``sample_hours``. An optional column ``beat``
    marks rows that are no samples but tell that a series has come as far as their time.

    What waits is written beside the log, batch by batch, and read by the next one, so its size
    is that of the last ``delay`` of samples. Samples are windowed by series and chunk of
    time as in batch jobs, so a series that holds most of them is spread over tasks.
    """
    wait, spark = parse_interval(delay).seconds, samples.sparkSession
    if not wait:
        raise ValueError("months have no fixed width")
    beat = F.coalesce("beat", F.lit(False)) if "beat" in samples.columns else F.lit(False)
    rows = samples.filter(F.col("meta_id").isNotNull() & F.col("series_timestamp").isNotNull()).select(
        F.col("meta_id").cast("int").alias("meta_id"),
        F.col("series_timestamp").cast("timestamp").alias("series_timestamp"),
        F.col("series_value").cast("double").alias("series_value"),
        F.when(beat, "beat").otherwise("new").alias("kind"),
    )

    def weigh(batch: DataFrame, number: int) -> None:
        log, state = own_log(spark, f"{path}/hours"), own_log(spark, f"{path}/state")
        weighed = _weighed(_left(spark, state.batch(number - 1) if number else None), batch, wait, chunk)
        state.write(weighed, state.batch(number))
        done = spark.read.schema(STATE).parquet(state.batch(number)).filter("kind in ('done', 'late')")
        done = done.select(*COLUMNS, "hours", (F.col("kind") == "late").alias("late"))
        log.write(done, log.batch(number))
        if number > 1:  # a batch starts from the one before, which is done for good once it runs
            drop_folder(spark, state.batch(number - 2))

    return (
        rows.writeStream.foreachBatch(weigh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _left(spark: SparkSession, folder: str | None) -> DataFrame:
    """What a batch leaves: waiting samples, the last weighed one and the newest beat of each series."""
    if folder is None:
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE).parquet(folder)
    newest = lambda *kinds: (
        rows.filter(F.col("kind").isin(*kinds))
        .groupBy("meta_id")
        .agg(F.max("series_timestamp").alias("series_timestamp"))
        .withColumn("kind", F.lit(kinds[0]))
    )
    left = rows.filter("kind = 'wait'")
    for one in (newest("last", "done"), newest("beat")):
        left = left.unionByName(one, allowMissingColumns=True)
    return left


def _weighed(left: DataFrame, batch: DataFrame, wait: int, chunk: str) -> DataFrame:
    """All rows at hand: weighed ones are done, others wait, are late, are the last or a beat."""
    ts = F.col("series_timestamp")
    both = left.drop("hours").withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False)))
    behind = F.make_dt_interval(secs=F.lit(wait))
    certain = broadcast_if_few(
        both.groupBy(F.col("meta_id").alias("series")).agg(
            (F.max(ts) - behind).alias("certain"), (F.max(F.when(F.col("old"), ts)) - behind).alias("was_certain")
        )
    )
    both = both.join(certain, F.col("meta_id") == F.col("series")).drop("series", "old")
    late = (F.col("kind") == "new") & F.coalesce(ts <= F.col("was_certain"), F.lit(False))
    both = both.withColumn("kind", F.when(late, "late").otherwise(F.col("kind")))
    near = sample_neighbours(both.filter(~F.col("kind").isin("late", "beat")), "chunked", chunk)
    quarter = F.make_dt_interval(secs=F.lit(int(MAX_HOURS * 3600)))
    followed = F.coalesce(F.col("after") <= F.col("certain"), F.lit(False)) | (ts + quarter <= F.col("certain"))
    done = (ts <= F.col("certain")) & (F.col("before").isNotNull() | followed)
    kind = F.when(F.col("kind") == "last", "last").when(done, "done").otherwise("wait")
    hours = F.when(F.col("kind") == "done", F.col("hours"))
    weighed = near.withColumns({"hours": hours_of(near), "kind": kind}).select(*COLUMNS, hours.alias("hours"), "kind")
    others = both.filter(F.col("kind").isin("late", "beat"))
    return weighed.unionByName(others.select(*COLUMNS, F.lit(None).cast("double").alias("hours"), "kind"))


def weighed_stream(spark: SparkSession, path: str) -> DataFrame:
    """All samples weighed so far: meta_id, series_timestamp, series_value, hours, late."""
    return only_log(spark, f"{path}/hours").read(WEIGHED)
