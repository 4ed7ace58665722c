"""Reading series and the registry."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from conftest import at
from wattframe.plans.series import (
    UnknownSeries,
    get_series,
    list_series,
    resample,
    series_scan,
    series_with_samples,
)
from wattframe.sources.json_lines import as_json, read_document, write_document, write_json
from wattframe.tables import META_SCHEMA, local_table

PRICE = 21


def test_scan_in_range(tables):
    t = tables([(PRICE, 0, 42), (5, 0, 1)])
    inside = series_scan(t, "smard_market_price", from_="2022-11-29T09:31:51Z")
    assert [(r.timestamp, r.value) for r in inside.datapoints.collect()] == [(at(0), 42.0)]
    assert inside.datapoints.columns == ["id", "timestamp", "value", "created_at", "updated_at"]


def test_scan_out_of_range_keeps_the_registry_row(tables):
    outside = series_scan(tables([(PRICE, 0, 42)]), "SMARD_market_price", to="2022-11-29T09:31:51Z")
    assert outside.datapoints.count() == 0
    row = outside.meta.first()
    assert (row.id, row.identifier, row.carrier, row.consumption) == (PRICE, "smard_market_price", None, None)


def test_range_ends_are_included(tables):
    t = tables([(PRICE, m, 1) for m in range(5)])
    found = series_scan(t, "smard_market_price", "2024-01-10T00:01:00Z", "2024-01-10T00:03:00Z")
    assert found.datapoints.count() == 3


def test_unknown_series_and_bad_range(tables):
    t = tables([])
    for query in (series_scan, get_series):
        with pytest.raises(UnknownSeries):
            query(t, "nothing")
    with pytest.raises(UnknownSeries):
        resample(t, "nothing", "1hour")
    with pytest.raises(ValueError):
        series_scan(t, "total_load", from_="23542365346747")
    with pytest.raises(ValueError):
        resample(t, "total_load", "invalid")


def test_mean_of_two(tables):
    t = tables([(PRICE, 0, 42), (PRICE, 0.05, 66), (PRICE, 180, 1)])
    rows = resample(t, "smard_market_price", "1hour").datapoints.collect()
    assert [tuple(r) for r in rows] == [(at(0), 54.0), (at(180), 1.0)]
    assert resample(t, "smard_market_price", "1hour", to="2022-11-29T09:31:51Z").datapoints.count() == 0


def test_of_several_units_the_lowest_id(tables, spark):
    rows = [
        (7, "Load", "kw", None, None, None, None, 0),
        (3, "load", "mw", 6, None, None, None, 0),
    ]
    t = tables([(3, 0, 1), (7, 0, 2)], meta=local_table(spark, rows, META_SCHEMA))
    assert series_scan(t, "LOAD").datapoints.first().value == 1.0
    row = get_series(t, "LOAD").collect()
    assert [(r.id, r.carrier) for r in row] == [(3, "solar")]


def test_listing(tables):
    t = tables([(5, 0, 1), (5, 90, 1), (9, 30, 1), (None, 0, 1)])
    rows = list_series(t).collect()
    assert [r.id for r in rows] == list(range(1, 22))
    assert (rows[4].min_timestamp, rows[4].max_timestamp) == (at(0), at(90))
    assert rows[0].min_timestamp is None and rows[8].carrier == "coal"
    assert [r.id for r in list_series(t, page=2, per_page=8).collect()] == [17, 18, 19, 20, 21]
    assert list_series(t, page=9).count() == 0
    assert [r.id for r in series_with_samples(t).orderBy("id").collect()] == [5, 9]


def test_json_results(tables, folder):
    t = tables([(PRICE, 0, 42)])
    found = series_scan(t, "smard_market_price").datapoints.drop("created_at", "updated_at")
    (text,) = (r[0] for r in found.select(as_json(found)).collect())
    assert json.loads(text) == {"id": 0, "timestamp": "2024-01-10T00:00:00.000000Z", "value": 42.0}
    write_json(get_series(t, "hard coal"), f"{folder}/out")
    lines = [f.read_text() for f in Path(folder, "out").glob("*.json")]
    assert json.loads("".join(lines))["min_timestamp"] is None


@pytest.mark.parametrize("n", [0, 1, 500])
def test_nested_documents(spark, tables, folder, n):
    """All parts, one after the other, are one JSON document in order of time."""
    t = tables([(PRICE, m * 7 % 500, m) for m in range(n)])
    found = series_scan(t, "smard_market_price")
    points = found.datapoints.drop("created_at", "updated_at")
    write_document(points, found.meta, f"{folder}/out")
    text = "".join(f.read_text() for f in sorted(Path(folder, "out").glob("part-*")))
    document = json.loads(text)
    assert document["meta"]["identifier"] == "smard_market_price" and document["meta"]["carrier"] is None
    assert [d["timestamp"] for d in document["datapoints"]] == sorted(d["timestamp"] for d in document["datapoints"])
    assert len(document["datapoints"]) == n
    again = read_document(spark, f"{folder}/out", "id long, timestamp timestamp, value double")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, points.select("id", "timestamp", "value").collect()))
