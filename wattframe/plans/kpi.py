"""Energy, emission and cost indicators.

``from_`` and ``to`` are RFC 3339 text or datetimes and bound a closed range; ``interval``
is text such as ``1hour``. Functions named ``total_..``, ``.._savings``, ``self_consumption``
and ``autarky`` return one row (value, name, unit, from_timestamp, to_timestamp).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wattframe.functions.instants import instant, time_span
from wattframe.functions.intervals import parse_interval, whole_buckets, with_bucket
from wattframe.functions.text import key
from wattframe.operators.energy import (
    bucket_energy,
    role_buckets,
    series_energy,
    with_carrier_name,
    with_shares,
)
from wattframe.operators.factors import factors_of
from wattframe.operators.series import (
    GRID_REFERENCE,
    MARKET_PRICE,
    TOTAL_LOAD,
    any_producer,
    choose,
    choose_with_carrier,
    grid_mix,
    local_consumer,
    local_producer,
    named,
    samples_of,
)
from wattframe.tables import DEFAULT_SOURCE, Tables

Instant = str | datetime | None

# Units as the results name them.
KWH = "kwh"
CONSUMER_KWH = "kWh"
EMISSION_UNIT = "kgco2eq"
CURRENCY = "EUR"
PRICE_PER_KWH = 1000.0  # prices are per MWh
WATTS = "w"
WATTS_PER_KW = 1000.0


def _result(
    t: Tables, df: DataFrame, value: Column, name: str, unit: str | None, span: tuple
) -> DataFrame:
    data_type = t.ts.schema["series_timestamp"].dataType
    return df.select(
        value.alias("value"),
        F.lit(name).alias("name"),
        F.lit(unit).cast("string").alias("unit"),
        instant(span[0], data_type).alias("from_timestamp"),
        instant(span[1], data_type).alias("to_timestamp"),
    )


def _total(t: Tables, role: Column, name: str, from_: Instant, to: Instant) -> DataFrame:
    span = time_span(from_, to)
    energy = series_energy(t, choose(t, role), *span).agg(F.sum("kwh").alias("kwh"))
    return _result(t, energy, F.coalesce("kwh", F.lit(0.0)), name, KWH, span)


def total_consumption(t: Tables, from_: Instant = None, to: Instant = None) -> DataFrame:
    """Energy of the total load; negative power counts as negative energy."""
    return _total(t, named(TOTAL_LOAD), "total_consumption", from_, to)


def total_production(t: Tables, from_: Instant = None, to: Instant = None) -> DataFrame:
    """Energy of all producers, local or not; negative power counts as negative energy."""
    return _total(t, any_producer(), "total_production", from_, to)


def _ratio(t: Tables, value: Column, name: str, from_: Instant, to: Instant) -> DataFrame:
    """``value`` may use column ``ratio``, consumption over production from one scan."""
    span = time_span(from_, to)
    load, producer = named(TOTAL_LOAD), any_producer()
    series = choose(t, load | producer, load.alias("load"), producer.alias("producer"))
    sums = series.describe(series_energy(t, series, *span)).agg(
        F.coalesce(F.sum(F.when(F.col("load"), F.col("kwh"))), F.lit(1.0)).alias("c"),
        F.coalesce(F.sum(F.when(F.col("producer"), F.col("kwh"))), F.lit(1.0)).alias("p"),
    )
    ratio = F.when(F.col("p") != 0, F.col("c") / F.col("p")).otherwise(F.col("c"))
    return _result(t, sums.select(ratio.alias("ratio")), value, name, None, span)


def self_consumption(t: Tables, from_: Instant = None, to: Instant = None) -> DataFrame:
    """Consumption over production, at most 1."""
    value = F.least("ratio", F.lit(1.0))
    return _ratio(t, value, "self_consumption", from_, to)


def autarky(t: Tables, from_: Instant = None, to: Instant = None) -> DataFrame:
    """Production over consumption, at most 1."""
    inverse = F.least(1.0 / F.col("ratio"), F.lit(1.0))
    value = F.when(F.col("ratio") == 0, F.lit(1.0)).otherwise(inverse)
    return _ratio(t, value, "autarky", from_, to)


def _ordered(df: DataFrame, *columns: str) -> DataFrame:
    """By bucket first; the other columns let a sort split a bucket with many rows."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


def _beside_drawn(mix: DataFrame) -> DataFrame:
    """Rows of the mix, each once per grid row of its bucket; without any, ``bucket`` is NULL."""
    mix = mix.filter(F.col("role") == "mix").withColumn("grid", F.explode_outer("drawn"))
    return mix.withColumn("bucket", F.when(F.col("grid").isNotNull(), F.col("bucket")))


def grid_consumption(
    t: Tables,
    interval: str,
    from_: Instant = None,
    to: Instant = None,
    on_zero: str = "error",
) -> DataFrame:
    """Carrier shares of the grid mix beside the energy drawn from the grid per bucket.

    Buckets with a mix but no grid reference keep their shares and have NULL elsewhere.
    ``on_zero="null"`` leaves shares of a zero total NULL instead of failing.
    """
    parse_interval(interval)
    roles = {"mix": grid_mix(), "grid": named(GRID_REFERENCE)}
    rows = role_buckets(t, roles, {"mix": ["carrier"], "grid": ["unit"]}, interval, *time_span(from_, to))
    parts = _beside_drawn(with_shares(t, rows, F.struct("kwh", "unit"), on_zero)).select(
        "bucket",
        F.col("grid.kwh").alias("bucket_consumption"),
        F.col("grid.unit").alias("consumption_unit"),
        F.col("share").alias("carrier_proportion"),
        "carrier_name",
    )
    return _ordered(parts, "bucket", "carrier_name")


def _local_parts(t: Tables, rows: DataFrame) -> DataFrame:
    return (
        with_carrier_name(t, rows)
        .groupBy("bucket", "carrier_name", "unit")
        .agg(F.sum("kwh_used").alias("bucket_consumption"))
        .select(
            "bucket",
            "bucket_consumption",
            F.col("unit").alias("consumption_unit"),
            F.lit(1.0).alias("carrier_proportion"),
            "carrier_name",
        )
    )


def local_production(
    t: Tables, interval: str, from_: Instant = None, to: Instant = None
) -> DataFrame:
    """Energy of local producers per bucket, carrier and unit; negative power counts as 0."""
    parse_interval(interval)
    series = choose(t, local_producer(), "carrier", "unit")
    rows = series.describe(bucket_energy(t, series, interval, *time_span(from_, to)))
    return _ordered(_local_parts(t, rows), "bucket", "carrier_name")


def consumption_by_carrier(
    t: Tables, interval: str, from_: Instant = None, to: Instant = None, on_zero: str = "error"
) -> DataFrame:
    """Grid energy split by the grid mix, and local production, per bucket and carrier.

    With ``on_zero="null"`` a bucket whose mix adds up to zero gives each carrier the whole
    energy instead of failing, as a missing share counts as 1.
    """
    parse_interval(interval)
    roles = {"mix": grid_mix(), "grid": named(GRID_REFERENCE), "made": local_producer()}
    keys = {"mix": ["carrier"], "grid": ["unit"], "made": ["carrier", "unit"]}
    rows = role_buckets(t, roles, keys, interval, *time_span(from_, to))
    rows = with_shares(t, rows, F.struct(F.coalesce("kwh", F.lit(0.0)).alias("kwh")), on_zero)
    share = F.coalesce("share", F.lit(1.0))
    bought = F.transform("drawn", lambda grid: share * grid["kwh"])
    made = F.when((F.col("role") == "made") & F.col("bucket").isNotNull(), F.array(F.coalesce("kwh_used", F.lit(0.0))))
    values = F.when(F.col("role") == "mix", bought).otherwise(made)
    return rows.filter(F.col("carrier_name").isNotNull() & (F.col("role") != "grid")).select(
        "bucket",
        "carrier_name",
        F.explode(values).alias("value"),
        F.lit(KWH).alias("unit"),
        (F.col("role") == "made").alias("local"),
    )


def local_consumption(
    t: Tables, interval: str, from_: Instant = None, to: Instant = None
) -> DataFrame:
    """Energy of each local consumer per bucket; meters in W are brought to kW here only."""
    parse_interval(interval)
    span = time_span(from_, to)
    is_watts = key("unit") == F.lit(WATTS)
    series = choose_with_carrier(
        t, local_consumer(), "identifier", is_watts.alias("in_watts")
    )
    in_kwh = F.when(F.col("in_watts"), F.col("kwh_used") / WATTS_PER_KW)
    rows = (
        series.describe(bucket_energy(t, series, interval, *span))
        .groupBy("bucket", F.col("identifier").alias("consumer_name"), "carrier_name")
        .agg(F.sum(in_kwh.otherwise(F.col("kwh_used"))).alias("value"))
        .select(
            "bucket",
            "consumer_name",
            "value",
            F.lit(CONSUMER_KWH).alias("unit"),
            "carrier_name",
        )
    )
    return _ordered(rows, "bucket", "consumer_name")


def _scope_one(t: Tables, rows: DataFrame, factors: DataFrame) -> DataFrame:
    return (
        with_carrier_name(t, rows)
        .groupBy("bucket", "carrier", "carrier_name", "identifier")
        .agg(F.sum("kwh_used").alias("kwh_used"))
        .join(factors.distinct(), "carrier")
        .select(
            "bucket",
            (F.col("kwh_used") * F.col("factor")).alias("value"),
            "carrier_name",
            F.lit(EMISSION_UNIT).alias("unit"),
        )
    )


def scope_one_emissions(
    t: Tables,
    interval: str,
    from_: Instant = None,
    to: Instant = None,
    source: str = DEFAULT_SOURCE,
) -> DataFrame:
    """Emissions of local producers, one row per bucket, producer and factor."""
    parse_interval(interval)
    series = choose(t, local_producer(), "carrier", "identifier")
    made = series.describe(bucket_energy(t, series, interval, *time_span(from_, to)))
    rows = _scope_one(t, made, factors_of(t, source))
    return _ordered(rows, "bucket", "carrier_name", "value")


def scope_two_emissions(
    t: Tables,
    interval: str,
    from_: Instant = None,
    to: Instant = None,
    source: str = DEFAULT_SOURCE,
    apply_factor: bool = False,
    on_zero: str = "error",
) -> DataFrame:
    """Grid energy split by the mix, for carriers that have an emission factor.

    The value is energy times share: the factor only selects carriers, unless
    ``apply_factor`` is set. A carrier with several factors gives several rows. Buckets
    without grid reference have NULL bucket and value.
    """
    parse_interval(interval)
    weight = F.col("factor") if apply_factor else F.lit(1.0)
    roles = {"mix": grid_mix(), "grid": named(GRID_REFERENCE)}
    keys = {"mix": ["carrier"], "grid": ["carrier"]}
    sums = role_buckets(t, roles, keys, interval, *time_span(from_, to))
    rows = (
        _beside_drawn(with_shares(t, sums, F.struct("kwh_used"), on_zero))
        .select("bucket", "carrier", "carrier_name", (F.col("grid.kwh_used") * F.col("share")).alias("kwh"))
        .join(factors_of(t, source), "carrier")
        .select(
            "bucket",
            (F.col("kwh") * weight).alias("value"),
            "carrier_name",
            F.lit(EMISSION_UNIT).alias("unit"),
        )
    )
    return _ordered(rows, "bucket", "carrier_name")


def total_co2_emissions(
    t: Tables,
    interval: str,
    from_: Instant = None,
    to: Instant = None,
    source: str = DEFAULT_SOURCE,
    on_zero: str = "error",
) -> DataFrame:
    """Sum of scope one and scope two emissions.

    Only a total is wanted, so factors are summed or counted per carrier before they meet
    the energy: the distinct ones in scope one, the rows in scope two.
    """
    parse_interval(interval)
    span = time_span(from_, to)
    roles = {"mix": grid_mix(), "grid": named(GRID_REFERENCE), "made": local_producer()}
    keys = dict.fromkeys(roles, ["carrier"])
    rows = with_shares(t, role_buckets(t, roles, keys, interval, *span), F.col("kwh_used"), on_zero)
    per_carrier = factors_of(t, source).groupBy("carrier").agg(
        F.sum_distinct("factor").alias("factors"), F.count(F.lit(1)).alias("rows")
    )
    drawn = F.aggregate("drawn", F.lit(0.0), lambda total, kwh: total + kwh)
    value = F.when(F.col("role") == "mix", drawn * F.col("share") * F.col("rows")).when(
        F.col("role") == "made", F.col("kwh_used") * F.col("factors")
    )
    total = (
        rows.filter(F.col("carrier_name").isNotNull())
        .join(per_carrier, "carrier")
        .agg(F.sum(value).alias("value"))
    )
    value = F.coalesce("value", F.lit(0.0))
    return _result(t, total, value, "total_co2_emissions", EMISSION_UNIT, span)


def co2_savings(
    t: Tables,
    interval: str,
    from_: Instant = None,
    to: Instant = None,
    source: str = DEFAULT_SOURCE,
    actual: str = "grid",
    on_zero: str = "error",
) -> DataFrame:
    """Emissions the local production would have caused with the grid mix, less the actual.

    Per bucket all pairs of a production carrier p and a grid carrier g with factor count:
    the sum of P(p)*share(g)*factor(g) less the mean of P(p)*factor(g). Both split into a
    production part and a grid part, so each side is summed alone and no pair is formed,
    nor a row per factor where carriers have several.
    ``actual="production"`` takes the producers' own factors in place of the mean.
    """
    if actual not in ("grid", "production"):
        raise ValueError(f"unknown actual emissions: {actual!r}")
    parse_interval(interval)
    span = time_span(from_, to)
    roles = {"mix": grid_mix(), "made": local_producer()}
    rows = role_buckets(t, roles, dict.fromkeys(roles, ["carrier"]), interval, *span)
    per_carrier = factors_of(t, source).groupBy("carrier").agg(
        F.sum("factor").alias("factors"),
        F.count(F.lit(1)).alias("rows"),
        F.avg("factor").alias("own_factor"),
    )
    rows = with_shares(t, rows, F.lit(0.0), on_zero).join(per_carrier, "carrier", "left")
    made, mix = F.col("role") == "made", F.col("role") == "mix"
    sums = rows.groupBy("bucket").agg(
        F.sum(F.when(made, F.col("kwh_used"))).alias("kwh"),
        F.count(F.when(made, 1)).alias("producers"),
        F.sum(F.when(made, F.col("kwh_used") * F.col("own_factor"))).alias("own"),
        F.sum(F.when(mix, F.col("share") * F.col("factors"))).alias("mixed_factor"),
        F.sum(F.when(mix, F.col("factors"))).alias("factors"),
        F.sum(F.when(mix, F.col("rows"))).alias("rows"),
    )
    mean = F.col("kwh") * F.col("factors") / (F.col("producers") * F.col("rows"))
    emitted = mean if actual == "grid" else F.coalesce("own", F.lit(0.0))
    saved = sums.filter((F.col("producers") > 0) & (F.col("rows") > 0) & F.col("bucket").isNotNull()).agg(
        F.sum(F.col("kwh") * F.col("mixed_factor") - emitted).alias("saved")
    )
    value = F.coalesce("saved", F.lit(0.0))
    return _result(t, saved, value, "co2_savings", EMISSION_UNIT, span)


def cost_savings(t: Tables, from_: Instant = None, to: Instant = None) -> DataFrame:
    """Market value of all producers' energy, hour by hour."""
    span = time_span(from_, to)
    made, price = any_producer(), named(MARKET_PRICE)
    flags = [F.coalesce(role, F.lit(False)).alias(name) for name, role in (("made", made), ("price", price))]
    series = choose(t, made | price, *flags)
    rows = series.describe(bucket_energy(t, series, "1hour", *span))
    sums = rows.groupBy("bucket").agg(
        F.sum(F.when(F.col("made"), F.col("kwh_used"))).alias("kwh"),
        F.sum(F.when(F.col("price"), F.try_divide("amount", "samples"))).alias("price"),
    )
    saved = sums.filter(F.col("bucket").isNotNull()).agg(
        F.sum(F.col("kwh") * (F.col("price") / PRICE_PER_KWH)).alias("saved")
    )
    value = F.coalesce("saved", F.lit(0.0))
    return _result(t, saved, value, "cost_savings", CURRENCY, span)


def total_grid_electricity_cost(
    t: Tables, interval: str, from_: Instant = None, to: Instant = None
) -> DataFrame:
    """Energy drawn from the grid times the mean price of each whole bucket.

    Prices count over whole buckets even where the range cuts one, so their scan is
    widened to the buckets the range touches. It is a scan of its own: with the energy it
    would be weighed over the wider range, where the first sample has another neighbour.
    """
    span = time_span(from_, to)
    drawn = (
        bucket_energy(t, choose(t, named(GRID_REFERENCE)), interval, *span)
        .groupBy("bucket")
        .agg(F.sum("kwh_used").alias("kwh"))
    )
    first, past = whole_buckets(interval, *span)
    series = choose(t, named(MARKET_PRICE))
    data_type = t.ts.schema["series_timestamp"].dataType
    quotes = samples_of(t, series, first, past).filter(
        F.col("series_timestamp") < instant(past, data_type)
    )
    prices = (
        with_bucket(quotes, interval)
        .groupBy("bucket")
        .agg((F.avg("series_value") / PRICE_PER_KWH).alias("price"))
    )
    cost = drawn.join(prices, "bucket").agg(
        F.sum(F.col("kwh") * F.col("price")).alias("cost")
    )
    value = F.coalesce("cost", F.lit(0.0))
    return _result(t, cost, value, "total_grid_electricity_cost", CURRENCY, span)
