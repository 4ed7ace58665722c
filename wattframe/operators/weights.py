"""Sample weights: the hours a power sample stands for.

A sample weighs the time since its predecessor in the series; the first sample of a
series weighs the time to its successor. Neither counts for more than a quarter of an
hour, which is also the weight of a lone sample. Predecessors are looked for among the
given rows only, so restrict the time range first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wattframe.functions.intervals import with_bucket
from wattframe.functions.sizes import broadcast_if_few

# Fixed value: the longest time a sample may stand for, in hours.
MAX_HOURS = 0.25
MICROS_PER_HOUR = 3.6e9

HOUR = "1hour"
ROWS_PER_CHUNK = 5_000_000
# An hour is cut into as many parts at most; the sketch tells shares to about a thousandth.
MOST_PARTS = 512
SKETCH_SIZE = 2000

#: Names used while samples are weighed; input columns must not have them.
CHUNK, OPENING, OPEN_VALUE, OPEN_AFTER = "chunk", "opening", "open_value", "open_after"


def _hours_between(start: Column, end: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", start, end)
    else:
        micros = F.unix_micros(end) - F.unix_micros(start)
    return micros / F.lit(MICROS_PER_HOUR)


def _neighbours_by_series(samples: DataFrame) -> DataFrame:
    series = Window.partitionBy("meta_id").orderBy("series_timestamp")
    return samples.withColumns(
        {
            "before": F.lag("series_timestamp").over(series),
            "after": F.lead("series_timestamp").over(series),
        }
    )


def dense_hours(samples: DataFrame) -> DataFrame:
    """Hours of a series with more samples than a task should sort: meta_id, hour, cuts.

    ``cuts`` are instants in microseconds that split the hour into parts of about equal size.
    Hours are counted first and only dense ones sketched. Counts and quantile sketches are
    merged before they are shuffled; a sketch holds some thousand instants however many samples
    there are.
    """
    hours = with_bucket(samples, HOUR, name="hour").filter(F.col("hour").isNotNull())
    counts = hours.groupBy("meta_id", "hour").agg(F.count(F.lit(1)).alias("rows"))
    dense = (
        hours.join(counts.where(F.col("rows") > ROWS_PER_CHUNK), ["meta_id", "hour"])
        .groupBy("meta_id", "hour", "rows")
        .agg(F.kll_sketch_agg_bigint(_micros(samples), F.lit(SKETCH_SIZE)).alias("sketch"))
    )
    shares = F.array(*(F.lit(k / MOST_PARTS) for k in range(1, MOST_PARTS)))
    parts = F.least(F.ceil(F.col("rows") / ROWS_PER_CHUNK), F.lit(MOST_PARTS))
    places = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.round(k * MOST_PARTS / parts).cast("int"))
    split = dense.select("meta_id", "hour", places.alias("places"), F.kll_sketch_get_quantile_bigint("sketch", shares).alias("at"))
    return split.select(
        "meta_id", "hour", F.array_distinct(F.transform("places", lambda k: F.element_at("at", k))).alias("cuts")
    )


def _micros(samples: DataFrame) -> Column:
    ts = F.col("series_timestamp")
    if isinstance(samples.schema["series_timestamp"].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def chunked(samples: DataFrame, chunk: str = HOUR) -> DataFrame:
    """Add ``chunk``, a stretch of time such that one task can sort a series' samples in it.

    An interval gives chunks of that width. ``auto`` reads the times once more beforehand and
    gives hours, those that are dense in parts of about equal size.
    """
    if chunk != "auto":
        return with_bucket(samples, chunk, name=CHUNK)
    dense = broadcast_if_few(dense_hours(samples).withColumnRenamed("meta_id", "dense_id"))
    rows = with_bucket(samples, HOUR, name="_hour")
    at = _micros(samples)
    part = F.coalesce(F.size(F.filter("cuts", lambda cut: cut <= at)), F.lit(0))
    joined = rows.join(dense, (F.col("meta_id") == F.col("dense_id")) & (F.col("_hour") == F.col("hour")), "left")
    part = F.when(F.col("cuts").isNull(), 0).otherwise(part)
    return joined.select(*samples.columns, F.struct(F.col("_hour").alias("hour"), part.alias("part")).alias(CHUNK))


def _inside() -> Window:
    return Window.partitionBy("meta_id", CHUNK).orderBy("series_timestamp")


def _neighbours_by_chunk(samples: DataFrame, chunk: str) -> DataFrame:
    """The same neighbours without ever sorting a whole series in one task.

    Rows are windowed per (series, chunk of time). Only the first and the last row of a chunk
    lack a neighbour; these rows meet again, series by series, so even a series holding most of
    the samples has two rows per chunk in its task. Both steps read one shuffle of the samples.
    """
    near = chunked(samples, chunk).withColumns(
        {
            "before": F.lag("series_timestamp").over(_inside()),
            "after": F.lead("series_timestamp").over(_inside()),
        }
    )
    columns = [*samples.columns, "before", "after"]
    whole = F.col("before").isNotNull() & F.col("after").isNotNull()
    # Of rows with equal times the one without a predecessor is its chunk's first.
    series = Window.partitionBy("meta_id").orderBy("series_timestamp", F.col("before").isNotNull())
    ends = near.filter(~whole).withColumns(
        {
            "before": F.coalesce("before", F.lag("series_timestamp").over(series)),
            "after": F.coalesce("after", F.lead("series_timestamp").over(series)),
        }
    )
    return near.filter(whole).select(*columns).unionByName(ends.select(*columns))


def sample_neighbours(samples: DataFrame, weighting: str = "chunked", chunk: str = HOUR) -> DataFrame:
    """Add ``before`` and ``after``, the neighbouring timestamps within the series.

    ``weighting`` is ``chunked`` (any series length) or, where every series is known to fit
    one task, ``series``; no size is guessed. ``chunk`` is an interval; wide ones suit sparse
    series, narrow ones dense series, and ``auto`` splits dense hours by counting beforehand.
    """
    samples = samples.filter(F.col("meta_id").isNotNull())
    if weighting == "series":
        return _neighbours_by_series(samples)
    if weighting == "chunked":
        return _neighbours_by_chunk(samples, chunk)
    raise ValueError(f"unknown weighting: {weighting!r}")


def sample_hours(samples: DataFrame, weighting: str = "chunked", chunk: str = HOUR) -> DataFrame:
    """Add ``hours``, the weight of each sample."""
    near = sample_neighbours(samples, weighting, chunk)
    return near.select(*samples.columns, hours_of(near).alias("hours"))


def hours_of(near: DataFrame) -> Column:
    """The weight of samples with their neighbours ``before`` and ``after``."""
    ts = F.col("series_timestamp")
    data_type = near.schema["series_timestamp"].dataType
    since = _hours_between(F.col("before"), ts, data_type)
    until = _hours_between(ts, F.col("after"), data_type)
    return F.least(F.coalesce(since, until), F.lit(MAX_HOURS))


def weighed_sums(samples: DataFrame, *by: str, weighting: str = "chunked", chunk: str = HOUR) -> DataFrame:
    """Sums per series and ``by``, columns that a sample's time decides and that grow with it.

    ``kwh`` is the plain sum of value times weight, ``kwh_used`` counts each negative product as
    zero, ``amount`` and ``samples`` are sum and number of the plain values. Samples are read
    and shuffled once.
    """
    if weighting != "chunked":
        rows = sample_hours(samples, weighting, chunk)
        return _sums(rows.withColumn("kwh", F.col("series_value") * F.col("hours")), "meta_id", *by)
    return joined_sums(chunk_sums(samples, *by, chunk=chunk), *by)


def chunk_sums(samples: DataFrame, *by: str, chunk: str = HOUR) -> DataFrame:
    """The sums per series, chunk of time and ``by``, without the first sample of each chunk.

    That one, whose predecessor lies in another chunk, is given as ``opening`` (its time),
    ``open_value`` and ``open_after`` (its successor in the chunk); ``first`` and ``last`` are
    the ends. Sums of different stretches of time may be computed apart and kept.
    """
    ts, data_type = F.col("series_timestamp"), samples.schema["series_timestamp"].dataType
    rows = chunked(samples.filter(F.col("meta_id").isNotNull()), chunk).withColumns(
        {
            "before": F.lag("series_timestamp").over(_inside()),
            "after": F.lead("series_timestamp").over(_inside()),
        }
    )
    opens = F.col("before").isNull()
    hours = F.least(_hours_between(F.col("before"), ts, data_type), F.lit(MAX_HOURS))
    return _sums(
        rows.withColumn("kwh", F.col("series_value") * F.when(~opens, hours)),
        "meta_id",
        CHUNK,
        *by,
        more=[
            F.max(F.when(opens, ts)).alias(OPENING),
            F.max(F.when(opens, F.col("series_value"))).alias(OPEN_VALUE),
            F.max(F.when(opens, F.col("after"))).alias(OPEN_AFTER),
            F.min(ts).alias("first"),
            F.max(ts).alias("last"),
        ],
    )


def joined_sums(sums: DataFrame, *by: str) -> DataFrame:
    """``chunk_sums`` per series and ``by``, now with the first samples of the chunks.

    The sums of a series, a row per chunk, meet in one task, where the row before tells the
    last sample before a chunk.
    """
    data_type = sums.schema["last"].dataType
    series = Window.partitionBy("meta_id").orderBy("last")
    since = _hours_between(F.lag("last").over(series), F.col(OPENING), data_type)
    until = _hours_between(F.col(OPENING), F.coalesce(F.col(OPEN_AFTER), F.lead("first").over(series)), data_type)
    opened = F.col(OPEN_VALUE) * F.least(F.coalesce(since, until), F.lit(MAX_HOURS))
    whole = F.when(F.col("opened").isNull(), F.col("kwh")).otherwise(F.coalesce("kwh", F.lit(0.0)) + F.col("opened"))
    used = F.col("kwh_used") + F.greatest(F.coalesce("opened", F.lit(0.0)), F.lit(0.0))
    both = sums.withColumn("opened", opened).select(
        "meta_id", *by, whole.alias("kwh"), used.alias("kwh_used"), "amount", "samples"
    )
    return both.groupBy("meta_id", *by).agg(*(F.sum(c).alias(c) for c in ("kwh", "kwh_used", "amount", "samples")))


def _sums(rows: DataFrame, *by: str, more: list[Column] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("kwh").alias("kwh"),
        F.sum(F.greatest(F.col("kwh"), F.lit(0.0))).alias("kwh_used"),
        F.sum("series_value").alias("amount"),
        F.count("series_value").alias("samples"),
        *more,
    )
