"""Indicators on small tables, quirks included."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from conftest import at
from wattframe.operators import series as choosing
from wattframe.plans import kpi
from wattframe.sources.event_log import SAMPLE_SERIES, event_tables, sample_registry
from wattframe.tables import CARRIER_NAMES, FACTOR_SCHEMA, META_SCHEMA, local_table, seed_factors

EVENTS = "/root/testdata/sf0.01"
ALL = ("1970-01-01T00:00:00Z", "2100-01-01T00:00:00Z")
DAY = ("2024-01-10T00:00:00Z", "2024-01-10T23:59:59Z")
CHP, LOAD, GRID, PV, LIGNITE, COAL, TRAFO, PRICE = 4, 5, 6, 7, 8, 9, 19, 21
KPIS = [
    (kpi.total_consumption, ()),
    (kpi.total_production, ()),
    (kpi.self_consumption, ()),
    (kpi.autarky, ()),
    (kpi.cost_savings, ()),
    (kpi.grid_consumption, ("1hour",)),
    (kpi.local_production, ("1hour",)),
    (kpi.consumption_by_carrier, ("1hour",)),
    (kpi.local_consumption, ("1day",)),
    (kpi.scope_one_emissions, ("1hour",)),
    (kpi.scope_two_emissions, ("1hour",)),
    (kpi.total_co2_emissions, ("1hour",)),
    (kpi.co2_savings, ("1hour",)),
    (kpi.total_grid_electricity_cost, ("1month",)),
]


def value(df):
    (row,) = df.collect()
    return round(row.value, 9)


def table(df, *columns):
    """Rows as tuples, numbers rounded, in a fixed order."""
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def test_totals_keep_negative_energy(tables):
    t = tables([(LOAD, 0, 8), (LOAD, 15, -4), (CHP, 0, 4), (PV, 0, -20)])
    assert value(kpi.total_consumption(t, *DAY)) == 1.0
    assert value(kpi.total_production(t, *DAY)) == -4.0
    row = kpi.total_consumption(t, *DAY).first()
    assert (row.name, row.unit) == ("total_consumption", "kwh")
    assert row.from_timestamp == at(0)


def test_totals_of_nothing_are_zero_and_ratios_one(tables):
    t = tables([(COAL, 0, 1)])
    assert value(kpi.total_consumption(t, *DAY)) == 0.0
    assert value(kpi.total_production(t, *DAY)) == 0.0
    assert value(kpi.self_consumption(t, *DAY)) == 1.0
    assert value(kpi.autarky(t, *DAY)) == 1.0
    assert kpi.autarky(t, *DAY).first().unit is None
    for total in (kpi.total_co2_emissions, kpi.co2_savings, kpi.total_grid_electricity_cost):
        assert value(total(t, "1hour", *DAY)) == 0.0
    assert value(kpi.cost_savings(t, *DAY)) == 0.0


@pytest.mark.parametrize(
    "load, made, self_consumption, autarky",
    [(4, 8, 0.5, 1.0), (8, 4, 1.0, 0.5), (0, 4, 0.0, 1.0), (8, 0, 1.0, 0.5), (-4, 8, -0.5, -2.0)],
)
def test_ratios(tables, load, made, self_consumption, autarky):
    t = tables([(LOAD, 0, load), (PV, 0, made)])
    assert value(kpi.self_consumption(t, *DAY)) == self_consumption
    assert value(kpi.autarky(t, *DAY)) == autarky


def test_only_one_side_of_a_ratio(tables):
    assert value(kpi.self_consumption(tables([(LOAD, 0, 2)]), *DAY)) == 0.5
    assert value(kpi.self_consumption(tables([(PV, 0, 8)]), *DAY)) == 0.5


def test_grid_shares_and_missing_reference(tables):
    t = tables([(LIGNITE, 0, 30), (COAL, 0, 10), (COAL, 60, 5), (GRID, 0, 8), (GRID, 10, -2)])
    found = table(
        kpi.grid_consumption(t, "1hour", *DAY),
        "bucket", "bucket_consumption", "consumption_unit", "carrier_proportion", "carrier_name",
    )
    kwh = round((8 - 2) / 6, 6)
    assert found == sorted(
        [
            (at(0), kwh, "kw", 0.75, "lignite"),
            (at(0), kwh, "kw", 0.25, "coal"),
            (None, None, None, 1.0, "coal"),
        ],
        key=str,
    )
    last = kpi.grid_consumption(t, "1hour", *DAY).collect()[-1]
    assert last.bucket is None
    assert all(r.bucket for r in kpi.consumption_by_carrier(t, "1hour", *DAY).collect())


def test_consumption_by_carrier(tables):
    t = tables([(LIGNITE, 0, 30), (COAL, 0, 10), (GRID, 0, 8), (PV, 0, 4), (PV, 20, -4), (CHP, 0, 2)])
    assert table(
        kpi.consumption_by_carrier(t, "1hour", *DAY), "carrier_name", "value", "unit", "local"
    ) == sorted(
        [
            ("lignite", 1.5, "kwh", False),
            ("coal", 0.5, "kwh", False),
            ("solar", 1.0, "kwh", True),
            ("biogas", 0.5, "kwh", True),
        ],
        key=str,
    )


def test_watts_count_only_for_consumers(tables):
    t = tables([(TRAFO, 0, 4000), (1, 0, 4), (LOAD, 0, 4), (GRID, 0, 4), (1, 20, -4)])
    assert table(
        kpi.local_consumption(t, "1hour", *DAY), "consumer_name", "value", "unit", "carrier_name"
    ) == [
        ("evse_cluster", 1.0, "kWh", "electricity"),
        (SAMPLE_SERIES[TRAFO - 1][0], 1.0, "kWh", "electricity"),
    ]


def test_clamping_is_per_sample(tables):
    t = tables([(PV, 0, 4), (PV, 15, -100), (PV, 30, 8)])
    assert value(kpi.local_production(t, "1hour", *DAY).withColumnRenamed("bucket_consumption", "value")) == 3.0


def test_scope_one_and_two(tables):
    t = tables([(PV, 0, 4), (CHP, 0, 8), (GRID, 0, 8), (LIGNITE, 0, 30), (COAL, 0, 10)])
    assert table(kpi.scope_one_emissions(t, "1hour", *DAY), "carrier_name", "value") == [
        ("biogas", 0.46), ("solar", 0.048),
    ]
    assert table(kpi.scope_two_emissions(t, "1hour", *DAY), "carrier_name", "value", "unit") == [
        ("coal", 0.5, "kgco2eq"), ("lignite", 1.5, "kgco2eq"),
    ]
    weighted = kpi.scope_two_emissions(t, "1hour", *DAY, apply_factor=True)
    assert table(weighted, "carrier_name", "value") == [("coal", 0.41), ("lignite", 1.23)]
    assert value(kpi.total_co2_emissions(t, "1hour", *DAY)) == 2.508


def test_unknown_source_falls_back(tables):
    t = tables([(PV, 0, 4)])
    assert table(kpi.scope_one_emissions(t, "1hour", *DAY, source="none"), "value") == [(0.048,)]


def test_repeated_factors(tables, spark):
    """Several factors give several rows; equal ones fall together for producers only."""
    solar, coal = CARRIER_NAMES.index("solar") + 1, CARRIER_NAMES.index("coal") + 1
    rows = [
        (1, solar, 1.0, "u", "X", None), (2, solar, 1.0, "u", "X", None), (3, solar, 3.0, "u", "X", None),
        (4, coal, 1.0, "u", "X", None), (5, coal, 1.0, "u", "X", None), (6, coal, 9.0, "u", "Y", None),
    ]
    t = tables([(PV, 0, 4), (GRID, 0, 8), (COAL, 0, 1)], factors=local_table(spark, rows, FACTOR_SCHEMA))
    assert table(kpi.scope_one_emissions(t, "1hour", *DAY, source="X"), "value") == [(1.0,), (3.0,)]
    assert table(kpi.scope_two_emissions(t, "1hour", *DAY, source="X"), "value") == [(2.0,), (2.0,)]


def test_co2_savings_pairs(tables):
    """Against all pairs of producers and grid carriers."""
    t = tables([(PV, 0, 4), (CHP, 0, 8), (LIGNITE, 0, 30), (11, 0, 10), (PV, 120, 4), (COAL, 180, 1)])
    made, shares = {"solar": 1.0, "biogas": 2.0}, {"lignite": 0.75, "gas": 0.25}
    factor = {"lignite": 0.82, "gas": 0.49}
    would = sum(p * s * factor[g] for p in made.values() for g, s in shares.items())
    mean = sum(p * factor[g] for p in made.values() for g in shares) / 4
    assert value(kpi.co2_savings(t, "1hour", *DAY)) == round(would - mean, 9)
    own = 1.0 * 0.048 + 2.0 * 0.230
    assert value(kpi.co2_savings(t, "1hour", *DAY, actual="production")) == round(would - own, 9)
    with pytest.raises(ValueError):
        kpi.co2_savings(t, "1hour", *DAY, actual="other")


def test_cost_savings_by_hour(tables):
    t = tables([(PV, 0, 4), (CHP, 30, 8), (PV, 70, 4), (PRICE, 10, 100), (PRICE, 50, 300), (PRICE, 130, 9)])
    assert value(kpi.cost_savings(t, *DAY)) == round((1 + 2) * 200 / 1000, 9)
    row = kpi.cost_savings(t, *DAY).first()
    assert (row.unit, row.from_timestamp) == ("EUR", at(0))


def test_grid_cost_uses_prices_of_whole_buckets(tables):
    t = tables([(GRID, 70, 8), (PRICE, 5, 100), (PRICE, 65, 200), (PRICE, 119, 600), (PRICE, 120, 7)])
    cut = ("2024-01-10T01:08:00Z", "2024-01-10T01:30:00Z")
    assert value(kpi.total_grid_electricity_cost(t, "1hour", *cut)) == round(2 * 400 / 1000, 9)
    assert value(kpi.total_grid_electricity_cost(t, "1day", *cut)) == round(2 * 907 / 4 / 1000, 9)


def test_a_zero_grid_total_is_an_error(tables):
    t = tables([(COAL, 0, 5), (LIGNITE, 0, -5), (GRID, 0, 1)])
    with pytest.raises(ArithmeticException):
        kpi.scope_two_emissions(t, "1hour", *DAY).collect()


def test_null_flags_and_carriers_drop_out(tables, spark):
    rows = [
        (1, "a", "kw", 6, False, None, None, 0),
        (2, "b", "kw", None, False, None, True, 0),
        (3, "c", "kw", 6, None, None, True, 0),
        (4, "d", "mwh", None, True, None, False, 0),
        (5, "e", "mwh", 1, True, None, False, 0),
        (6, "Grid_Reference_SMARD", "kW", 12, True, None, True, 0),
    ]
    t = tables([(i, 0, 4) for i in range(1, 7)], meta=local_table(spark, rows, META_SCHEMA))
    assert value(kpi.total_production(t, *DAY)) == 2.0
    assert kpi.local_production(t, "1hour", *DAY).count() == 0
    assert table(kpi.scope_two_emissions(t, "1hour", *DAY), "carrier_name", "value") == [("coal", 1.0)]


@pytest.mark.parametrize("function, args", KPIS, ids=lambda v: getattr(v, "__name__", None))
def test_plans_for_large_tables_give_the_same(spark, monkeypatch, function, args):
    """Chunked weights, a registry too long for literal ids, no broadcast."""
    plain = function(event_tables(spark, EVENTS), *args, *ALL)
    columns = plain.columns
    wanted = table(plain, *columns)
    monkeypatch.setattr(choosing, "LITERAL_IDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert table(function(event_tables(spark, EVENTS, "chunked"), *args, *ALL), *columns) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert wanted


@pytest.mark.parametrize("interval", ["1hour", "1year"])
def test_scopes_sum_to_the_total(spark, interval):
    t = event_tables(spark, EVENTS)
    parts = [f(t, interval, *ALL) for f in (kpi.scope_one_emissions, kpi.scope_two_emissions)]
    total = sum(p.agg(F.sum("value")).first()[0] for p in parts)
    assert math.floor(total) == math.floor(value(kpi.total_co2_emissions(t, interval, *ALL)))


def test_grid_rows_sum_to_the_reference(spark):
    t = event_tables(spark, EVENTS)
    parts = kpi.grid_consumption(t, "1day", *ALL).groupBy("bucket")
    rows = parts.agg(
        F.sum("carrier_proportion").alias("share"),
        F.sum(F.col("carrier_proportion") * F.col("bucket_consumption")).alias("kwh"),
        F.max("bucket_consumption").alias("drawn"),
    ).filter("bucket is not null").collect()
    assert len(rows) == 30
    for row in rows:
        assert row.share == pytest.approx(1.0)
        assert row.kwh == pytest.approx(row.drawn)


def test_bad_arguments(spark):
    t = event_tables(spark, EVENTS)
    for function in (kpi.consumption_by_carrier, kpi.scope_one_emissions, kpi.co2_savings,
                     kpi.total_grid_electricity_cost, kpi.local_consumption):
        with pytest.raises(ValueError):
            function(t, "1hours", *ALL)
    with pytest.raises(ValueError):
        kpi.total_consumption(t, "23542365346747")


def test_a_registry_has_no_case(spark, tables):
    meta = sample_registry(spark).withColumn("identifier", F.upper("identifier")).withColumn("unit", F.upper("unit"))
    rows = [(LOAD, 0, 4), (TRAFO, 0, 4000), (GRID, 0, 4), (COAL, 0, 1), (PRICE, 0, 10)]
    upper, lower = tables(rows, meta=meta), tables(rows)
    assert value(kpi.total_consumption(upper, *DAY)) == value(kpi.total_consumption(lower, *DAY)) == 1.0
    assert table(kpi.local_consumption(upper, "1hour", *DAY), "value") == [(1.0,)]
    assert value(kpi.total_grid_electricity_cost(upper, "1hour", *DAY)) == 0.01


def test_seed_factors(spark):
    from wattframe.operators.factors import average_factors, list_factors
    from wattframe.tables import Tables, seed_carriers

    seeds = seed_factors(spark)
    t = Tables(seeds, seeds, seed_carriers(spark), seeds)
    factors = {r.carrier: r.factor for r in list_factors(t).collect()}
    assert factors["coal"] == 0.82 and len(factors) == 13
    assert "oil" not in factors and "electricity" not in factors
    means = average_factors(seed_factors(spark, averaged=False), seed_carriers(spark)).collect()
    assert {r.carrier_name: round(r.factor, 12) for r in means} == {
        "other_conventional": 0.5355, "other_renewable": 0.0925, "pumped_storage": 0.0925,
    }
    assert list_factors(t, "IPCC", "gas").first().factor == 0.49
    assert list_factors(t, "other").count() == 0
