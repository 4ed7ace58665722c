"""What the plans read, shuffle and broadcast."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import samples
from wattframe.functions.instants import time_span
from wattframe.operators import series as choosing
from wattframe.operators.weights import sample_hours
from wattframe.plans import kpi, series
from wattframe.sources.event_log import sample_registry
from wattframe.sources.samples import append_samples, read_samples, stored_form
from wattframe.tables import Tables, seed_carriers, seed_factors

SPAN = ("2024-02-03T00:00:00Z", "2024-02-25T12:30:00Z")
SPANS = time_span(*SPAN)


@pytest.fixture(scope="module")
def stored(spark):
    """Three months of all series, in table form."""
    import tempfile

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/ts"
    rows = spark.range(21 * 91 * 24).select(
        (F.col("id") % 21 + 1).cast("int").alias("meta_id"),
        F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 21) * 3600).alias("series_timestamp"),
        (F.col("id") % 97 + 1).cast("double").alias("series_value"),
    )
    append_samples(rows, path)
    return Tables(read_samples(spark, path), sample_registry(spark), seed_carriers(spark), seed_factors(spark))


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize(
    "query, ids",
    [
        (lambda t: kpi.total_consumption(t, *SPAN), "meta_id,5"),
        (lambda t: kpi.local_production(t, "1hour", *SPAN), "meta_id, [4,7]"),
        (lambda t: series.series_scan(t, "total_load", *SPAN).datapoints, "meta_id,5"),
        (lambda t: series.resample(t, "total_load", "1day", *SPAN).datapoints, "meta_id,5"),
    ],
)
def test_series_months_and_times_reach_the_scan(stored, query, ids):
    text = plan(query(stored))
    assert "PartitionFilters: [isnotnull(month" in text
    assert ">= 2024-02-01" in text and "<= 2024-02-01" in text
    (pushed,) = set(re.findall(r"PushedFilters: \[(.*)\]\n", text))
    assert ids in pushed and "GreaterThanOrEqual(series_timestamp" in pushed


def test_only_needed_columns_are_read(stored):
    text = plan(kpi.local_consumption(stored, "1hour", *SPAN))
    assert set(re.findall(r"ReadSchema: (.*)\n", text)) == {
        "struct<series_timestamp:timestamp,series_value:double,meta_id:int>"
    }
    assert set(re.findall(r"ReadSchema: (.*)\n", plan(series.list_series(stored)))) == {
        "struct<series_timestamp:timestamp,meta_id:int>"
    }


def test_no_python_and_no_cross_joins(stored):
    queries = [
        kpi.consumption_by_carrier(stored, "1hour"),
        kpi.scope_two_emissions(stored, "1hour"),
        kpi.total_co2_emissions(stored, "1month"),
        kpi.co2_savings(stored, "1hour"),
        kpi.autarky(stored),
        kpi.cost_savings(stored),
        kpi.total_grid_electricity_cost(stored, "1hour"),
        series.list_series(stored),
    ]
    for df in queries:
        text = plan(df)
        assert not re.search("Python|ArrowEval|CartesianProduct|BroadcastNestedLoop|MapInPandas", text)


def test_weighing_by_series_needs_one_shuffle(stored):
    """Windows and sums per series and bucket share it."""
    text = plan(kpi.total_consumption(replace(stored, weighting="series"), *SPAN))
    assert text.count(") Exchange\n") == 2  # by series, and for the total
    assert "hashpartitioning(meta_id" in text


def scans(df) -> int:
    """Scans of samples that a finished plan has, those behind reused shuffles left out."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet .*series_timestamp", text))


def test_rows_and_their_ends_come_from_one_shuffle(stored):
    rows = sample_hours(stored.ts.select("meta_id", "series_timestamp", "series_value"), "chunked")
    text = plan(rows)
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\n", text)
    assert "Join" not in text
    assert scans(rows) == 1 and len(exchanges) <= 3


INDICATORS = {
    "total_consumption": (),
    "total_production": (),
    "self_consumption": (),
    "autarky": (),
    "cost_savings": (),
    "grid_consumption": ("1hour",),
    "local_production": ("1hour",),
    "consumption_by_carrier": ("1hour",),
    "local_consumption": ("1hour",),
    "scope_one_emissions": ("1hour",),
    "scope_two_emissions": ("1hour",),
    "total_co2_emissions": ("1hour",),
    "co2_savings": ("1hour",),
    "total_grid_electricity_cost": ("1hour",),
}


@pytest.mark.parametrize("name", sorted(INDICATORS))
def test_indicators_read_samples_once_and_write_nothing(spark, stored, name, monkeypatch):
    """The grid cost alone reads prices apart, over a wider range; building a plan stages nothing."""
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: pytest.fail("a table was written"))
    df = getattr(kpi, name)(stored, *INDICATORS[name], *SPAN)
    before = plan(df)
    expected = 2 if name == "total_grid_electricity_cost" else 1
    assert len(re.findall(r"ReadSchema: .*series_timestamp", before)) == expected
    assert scans(df) == expected
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\n", before)
    assert sum("series_value" in columns for columns in moved) == expected - (name == "total_grid_electricity_cost")


def test_stored_form_is_shuffled_once(spark):
    text = plan(stored_form(samples(spark, [(1, 0, 1)])))
    assert text.count(") Exchange\n") == 1 and "rangepartitioning(month" in text


def test_long_registries_become_semi_joins(spark, stored, monkeypatch):
    monkeypatch.setattr(choosing, "LITERAL_IDS", 0)
    text = plan(kpi.total_production(stored, *SPAN))
    assert "LeftSemi" in text
    assert "meta_id, [4,7]" not in text


@pytest.mark.parametrize("ids", [7, 8, 9])
def test_literal_ids_just_at_their_limit(stored, monkeypatch, ids):
    """Two more than, as many as, and fewer ids than may be written as literals."""
    monkeypatch.setattr(choosing, "LITERAL_IDS", 11)
    chosen = choosing.choose(stored, F.col("id") <= ids + 3)
    assert chosen.bounded == (ids + 3 <= 11)
    assert choosing.samples_of(stored, chosen, *SPANS).select("meta_id").distinct().count() == ids + 3
