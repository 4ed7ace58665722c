"""Indicators from kept hourly sums against indicators from samples."""

from __future__ import annotations

import random
import re
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

import pytest

from test_plans import plan
from wattframe.functions.intervals import parse_interval
from wattframe.plans import kpi
from wattframe.sources import hourly, samples
from wattframe.sources.event_log import sample_registry
from wattframe.tables import Tables, seed_carriers, seed_factors

COLUMNS = "meta_id int, series_timestamp timestamp, series_value double"
START = datetime(2024, 1, 30, 20)


def some(spark, seed, n):
    """Samples of six series around the end of a month, with gaps of every kind."""
    rng, rows = random.Random(seed), set()
    for series in (4, 5, 6, 8, 9, 21):
        at_ = START
        for _ in range(n):
            at_ += timedelta(seconds=rng.choice([1, 60, 500, 900, 901, 3600, 3601, 20000]))
            rows.add((series, at_, float(rng.randrange(-3, 9))))
    return spark.createDataFrame(sorted(rows), COLUMNS)


@pytest.fixture(scope="module")
def kept(spark):
    import tempfile

    place = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = some(spark, 1, 120)
    for part in range(3):
        batch = rows.filter(f"pmod(xxhash64(series_timestamp, meta_id), 3) = {part}")
        samples.append_samples(batch, f"{place}/ts")
        hourly.refresh_hourly(spark, f"{place}/ts", f"{place}/hourly", hourly.touched_months(batch))
    ts = samples.read_samples(spark, f"{place}/ts")
    t = Tables(ts, sample_registry(spark), seed_carriers(spark), seed_factors(spark))
    return place, t, replace(t, hourly=hourly.read_hourly(spark, f"{place}/hourly"))


def rounded(df):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


SPANS = [
    (None, None),
    ("2024-01-31T05:00:00Z", "2024-02-02T06:59:59.999999Z"),
    ("2024-01-31T05:20:11Z", "2024-02-02T06:17:00Z"),
    ("2024-01-31T05:20:11Z", "2024-01-31T05:40:00Z"),
    ("2024-01-31T23:00:00Z", "2024-02-01T00:00:00Z"),
    ("2030-01-01T00:00:00Z", "2030-02-01T00:00:00Z"),
]


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize(
    "name, args",
    [("total_consumption", ()), ("total_production", ()), ("cost_savings", ()), ("grid_consumption", ("1hour", "null")),
     ("consumption_by_carrier", ("1day", "null")), ("local_production", ("15min",)), ("local_production", ("1month",))],
)
def test_hourly_sums_give_the_same(kept, span, name, args):
    _, plain, fast = kept
    args, more = (args[:1], {"on_zero": "null"}) if "null" in args else (args, {})
    span = span if span[0] else ("1970-01-01T00:00:00Z", "2100-01-01T00:00:00Z")
    call = lambda t: rounded(getattr(kpi, name)(t, *args, *span, **more))
    assert call(fast) == call(plain)


def test_months_that_are_over_are_not_read(spark, kept):
    _, _, fast = kept
    whole = kpi.grid_consumption(fast, "1hour", "2024-01-01T00:00:00Z", "2024-02-28T23:59:59.999999Z")
    assert "opening" in plan(whole) and "series_timestamp" not in plan(whole)
    cut = kpi.grid_consumption(fast, "1hour", "2024-01-01T00:00:00Z", "2024-02-28T10:30:00Z")
    scans = re.findall(r"PartitionFilters: \[(.*)\]\nPushedFilters: \[(.*)\]\n", plan(cut))
    own = [months for months, pushed in scans if "series_timestamp" in pushed]
    assert len(own) == 1 and "2024-02-01" in own[0] and "2024-01-01" not in own[0]


def test_only_touched_months_are_made_anew(spark, folder):
    rows = [(5, datetime(2024, m, 3, 1, 10), float(m)) for m in (1, 2, 3)]
    batch = lambda own: spark.createDataFrame(own, COLUMNS)
    samples.append_samples(batch(rows), f"{folder}/ts")
    hourly.refresh_hourly(spark, f"{folder}/ts", f"{folder}/hourly")
    files = lambda: {f.split("/")[-2]: f for (f,) in hourly.read_hourly(spark, f"{folder}/hourly").selectExpr("_metadata.file_path").distinct().collect()}
    before = files()
    more = batch([(5, datetime(2024, 2, 3, 1, 5), 7.0)])
    samples.append_samples(more, f"{folder}/ts")
    assert hourly.touched_months(more) == [date(2024, 2, 1)]
    for _ in range(2):
        hourly.refresh_hourly(spark, f"{folder}/ts", f"{folder}/hourly", hourly.touched_months(more))
    after = files()
    assert {m for m in after if after[m] != before[m]} == {"month=2024-02-01"}
    assert hourly.read_hourly(spark, f"{folder}/hourly").filter("samples = 2").count() == 1
    assert hourly.read_hourly(spark, f"{folder}/none").collect() == []


def test_whole_hours_and_fitting_intervals():
    utc = lambda *a: datetime(2024, 1, 1, *a, tzinfo=timezone.utc)
    assert hourly.whole_hours(utc(1), utc(3)) == (utc(1), utc(3))
    assert hourly.whole_hours(utc(1, 0, 1), utc(3, 59, 59, 999999)) == (utc(2), utc(4))
    fitting = [i for i in ("15min", "60min", "90min", "1hour", "5hour", "1week", "1month") if hourly.fits(parse_interval(i))]
    assert fitting == ["60min", "1hour", "5hour", "1week", "1month"]
