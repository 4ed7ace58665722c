"""Intervals, instants, text and numbering."""

from __future__ import annotations

import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from wattframe.functions.instants import EPOCH, instant, parse_instant, time_span
from wattframe.functions.intervals import (
    Interval,
    parse_interval,
    time_window,
    whole_buckets,
    with_bucket,
)
from wattframe.functions.text import key, number_or_zero
from wattframe.functions.sizes import broadcast_if_few
from wattframe.operators import numbering
from wattframe.tables import local_table

UTC = timezone.utc
ID_SCHEMA = T.StructType([T.StructField("id", T.IntegerType())])
TEXT = T.StructType([T.StructField("raw", T.StringType())])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1hour", Interval(seconds=3600)),
        ("30min", Interval(seconds=1800)),
        ("2day", Interval(seconds=172800)),
        ("3week", Interval(seconds=3 * 604800)),
        ("5month", Interval(months=5)),
        ("2year", Interval(months=24)),
    ],
)
def test_interval_text(text, expected):
    assert parse_interval(text) == expected


@pytest.mark.parametrize(
    "text",
    ["invalid", "", "12", "hour", "1hours", "1.5hour", "x1hour", "0min", "-1day", "1 hour",
     "1hour\n", "99999999999min", "1Hour"],
)
def test_bad_interval_text(text):
    with pytest.raises(ValueError):
        parse_interval(text)


def test_calendar_buckets_are_no_windows(spark):
    with pytest.raises(ValueError):
        time_window(F.col("x"), "1month")


MOMENTS = [
    datetime(1969, 7, 20, 20, 17, 40),
    datetime(1999, 12, 31, 23, 59, 59, 999999),
    datetime(2000, 1, 1),
    datetime(2000, 1, 3),
    datetime(2024, 2, 29, 12, 30),
    datetime(2031, 11, 5, 0, 0, 0, 1),
]


@pytest.mark.parametrize("interval", ["7min", "5hour", "1day", "2week", "1month", "5month", "2year"])
@pytest.mark.parametrize("kind", [T.TimestampType(), T.TimestampNTZType()])
def test_bucket_starts_agree_with_whole_buckets(spark, interval, kind):
    schema = T.StructType([T.StructField("t", kind)])
    rows = with_bucket(local_table(spark, [(m,) for m in MOMENTS], schema), interval, "t").collect()
    assert len(rows) == len(MOMENTS)
    for row in rows:
        first, past = whole_buckets(interval, row.t.replace(tzinfo=UTC), row.t.replace(tzinfo=UTC))
        assert row.bucket.replace(tzinfo=UTC) == first
        assert first <= row.t.replace(tzinfo=UTC) < past


@settings(max_examples=200, deadline=None)
@given(
    st.datetimes(datetime(1900, 1, 1), datetime(2200, 1, 1)),
    st.integers(1, 40),
    st.sampled_from(["min", "hour", "day", "week", "month", "year"]),
)
def test_whole_buckets_tile_time(moment, count, unit):
    moment = moment.replace(tzinfo=UTC)
    first, past = whole_buckets(f"{count}{unit}", moment, moment)
    assert first <= moment < past
    assert whole_buckets(f"{count}{unit}", first, first) == (first, past)
    assert whole_buckets(f"{count}{unit}", past, past)[0] == past


def test_calendar_buckets_need_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.range(1).select(F.timestamp_seconds("id").alias("t"))
        with pytest.raises(ValueError):
            with_bucket(rows, "1month", "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_week_starts_on_monday(spark):
    schema = T.StructType([T.StructField("t", T.TimestampType())])
    row = with_bucket(local_table(spark, [(datetime(2024, 1, 14, 23),)], schema), "1week", "t").first()
    assert row.bucket == datetime(2024, 1, 8)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2022-11-29T09:31:51Z", datetime(2022, 11, 29, 9, 31, 51, tzinfo=UTC)),
        ("2022-11-29T09:31:51.5+02:00", datetime(2022, 11, 29, 7, 31, 51, 500000, tzinfo=UTC)),
    ],
)
def test_instants(text, expected):
    assert parse_instant(text) == expected


@pytest.mark.parametrize(
    "text", ["23542365346747", "2022-11-29", "2022-11-29 09:31:51Z", "2022-11-29T09:31:51", ""]
)
def test_bad_instants(text):
    with pytest.raises(ValueError):
        parse_instant(text)


def test_default_span():
    start, end = time_span(None, None)
    assert start == EPOCH
    assert abs((datetime.now(UTC) - end).total_seconds()) < 60


def test_instant_literals_do_not_depend_on_the_zone(spark):
    moment = datetime(2024, 1, 10, 12, tzinfo=UTC)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(
            F.unix_seconds(instant(moment, T.TimestampType())).alias("s"),
            instant(moment, T.TimestampNTZType()).cast("string").alias("n"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.s, row.n) == (int(moment.timestamp()), "2024-01-10 12:00:00")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("1.5", 1.5), ("-2", -2.0), ("+.5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1E-2", 0.01),
        ("", 0.0), (None, 0.0), ("abc", 0.0), (" 1", 0.0), ("1 ", 0.0), ("1,5", 0.0), ("1d", 0.0),
        ("1f", 0.0), ("0x1p3", 0.0), (".", 0.0), ("1e", 0.0), ("--1", 0.0), ("1e5.0", 0.0),
        ("inf", math.inf), ("-Infinity", -math.inf), ("+INF", math.inf), ("1e999", math.inf),
    ],
)
def test_lenient_numbers(spark, raw, expected):
    df = local_table(spark, [(raw,)], TEXT)
    assert df.select(number_or_zero(F.col("raw")).alias("n")).first().n == expected


def test_nan_is_a_number(spark):
    df = local_table(spark, [("NaN",), ("-nan",)], TEXT)
    assert all(math.isnan(r.n) for r in df.select(number_or_zero(F.col("raw")).alias("n")).collect())


def test_keys_ignore_case_but_not_accents(spark):
    df = local_table(spark, [("Straße",), ("STRASSE",), ("strasse",), ("strässe",)], TEXT)
    assert df.filter(key("raw") == F.lit("Strasse")).count() == 2
    assert df.filter(~key("raw").isin("STRASSE", "x")).count() == 2


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_ids_follow_the_order_for_any_partitioning(spark, partitions):
    """One hot row among many; the same ids however the rows are spread."""
    rows = spark.range(500).select((F.col("id") % 90).alias("a"), F.lit(None).cast("string").alias("b"))
    rows = rows.unionByName(spark.range(300).select(F.lit(-1).cast("long").alias("a"), F.lit("hot").alias("b")))
    existing = local_table(spark, [(3,), (41,)], ID_SCHEMA)
    numbered = numbering.with_next_ids(rows.repartition(partitions), existing)
    assert numbered.schema["id"].dataType == T.IntegerType()
    found = sorted(map(tuple, numbered.collect()))
    assert [r[0] for r in found] == list(range(42, 842))
    assert [r[1] for r in found] == sorted(r[1] for r in found)
    assert sum(r[2] == "hot" for r in found) == 300


def test_ids_do_not_depend_on_estimates(spark):
    """The same rows as a plain range, and exploded from one row that Spark takes for tiny."""
    plain = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("a"))
    exploded = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1999).cast("long"))).alias("a"))
    none = local_table(spark, [], ID_SCHEMA)
    ids = [{r.a: r.id for r in numbering.with_next_ids(df, none).collect()} for df in (plain, exploded)]
    assert ids[0] == ids[1] == {a: a + 1 for a in range(2000)}


def test_order_columns_give_the_ids(spark):
    rows = spark.range(50).select((49 - F.col("id")).alias("position"), F.col("id").alias("a"))
    found = numbering.with_next_ids(rows, local_table(spark, [], ID_SCHEMA), "position").collect()
    assert {r.a: r.id for r in found} == {a: 50 - a for a in range(50)}


def test_exploded_rows_are_counted_before_a_broadcast(spark):
    many = spark.range(1).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5000).cast("long"))).alias("id"))
    few = spark.range(3)
    for df, joins in ((many, "SortMergeJoin"), (few, "BroadcastHashJoin")):
        joined = spark.range(10_000).join(broadcast_if_few(df, 1000), "id")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert joins in text and ("Broadcast" in text) == (df is few)


def test_first_id_is_one(spark):
    empty = local_table(spark, [], ID_SCHEMA)
    assert numbering.with_next_ids(spark.range(1).select(F.lit("x").alias("x")), empty).first().id == 1
