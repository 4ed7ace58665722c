"""Queries by name; each takes the session and the folder of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.functions.instants import rfc_3339, time_span
from wattframe.functions.intervals import with_bucket
from wattframe.functions.sizes import folder_names, shared_folder
from wattframe.functions.text import number_or_zero
from wattframe.operators.energy import mix_shares
from wattframe.operators.factors import (
    append_factors as append_stored_factors,
    average_factors,
    list_factors,
    new_factors,
    read_factors,
    rejected_factors,
    resolve_sources,
)
from wattframe.operators.series import MARKET_PRICE, in_range, named
from wattframe.operators.weights import sample_hours, sample_neighbours
from wattframe.plans import kpi, series
from wattframe.sources import (
    extents,
    hourly,
    json_lines,
    points,
    prices,
    registry,
    samples,
    technology,
    wide_csv,
)
from wattframe.sources.event_log import (
    SAMPLE_SERIES,
    event_samples,
    event_tables,
    sample_registry,
    series_of_event,
)
from wattframe.streaming import prices as price_stream, resample as mean_stream, weights as weight_stream
from wattframe.tables import CARRIER_NAMES, Tables, seed_carriers, seed_factors

Query = Callable[[SparkSession, str], DataFrame]

ALL = ("1970-01-01T00:00:00Z", "2100-01-01T00:00:00Z")
CUT = ("2024-01-03T00:00:00Z", "2024-01-25T12:30:00Z")
# Digits that are left out of comparisons: sums of doubles depend on their order. Few
# digits for grand totals, many where exact decimals would otherwise be rounding ties.
TOTAL_DIGITS, ROW_DIGITS, MEAN_DIGITS = 4, 7, 9

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the name of the function; results are given in UTC."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def add(name: str, function: Query) -> None:
    function.__name__ = name
    query(function)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Columns that mix values and NULLs, in a form all engines print alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


FLAGS = ("consumption", "local")


# --- buckets and weights ---------------------------------------------------------------


def bucket_query(interval: str, name: str, id_column: str, ts: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, name).select(id_column, ts)
        return with_bucket(rows, interval, ts).select(id_column, "bucket")

    return run


EVENT_INTERVALS = ["7min", "15min", "1hour", "5hour"]
ORDER_INTERVALS = ["1day", "2day", "1week", "3week", "1month", "3month", "5month", "1year", "2year"]
for _interval in EVENT_INTERVALS:
    add(f"time_bucket_{_interval}", bucket_query(_interval, "events", "event_id", "ts"))
for _interval in ORDER_INTERVALS:
    add(f"time_bucket_{_interval}", bucket_query(_interval, "orders", "o_orderkey", "o_orderdate"))


def weighed(weighting: str, span: tuple[str, str]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = event_tables(spark, folder)
        rows = in_range(t.ts, *time_span(*span)).select("id", "meta_id", "series_timestamp")
        return sample_hours(rows, weighting)

    return run


add("sample_hours", weighed("series", ALL))
add("sample_hours_ranged", weighed("series", CUT))
add("sample_hours_chunked", weighed("chunked", ALL))
add("sample_hours_chunked_ranged", weighed("chunked", CUT))


@query
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    t = event_tables(spark, folder)
    return sample_neighbours(t.ts.select("id", "meta_id", "series_timestamp"), "chunked")


@query
def grid_mix_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = mix_shares(event_tables(spark, folder), "1hour", *time_span(*ALL))
    return shares.select("bucket", "carrier_name", F.round("share", 6).alias("share"))


# --- series and registry ---------------------------------------------------------------


@query
def series_scan(spark: SparkSession, folder: str) -> DataFrame:
    return series.series_scan(event_tables(spark, folder), "Total_Load", *ALL).datapoints


@query
def series_scan_ranged(spark: SparkSession, folder: str) -> DataFrame:
    return series.series_scan(event_tables(spark, folder), "Total_Load", *CUT).datapoints


@query
def resample_mean(spark: SparkSession, folder: str) -> DataFrame:
    found = series.resample(event_tables(spark, folder), MARKET_PRICE, "1hour", *ALL)
    return rounded(found.datapoints, MEAN_DIGITS, "mean_value")


@query
def resample_mean_ranged(spark: SparkSession, folder: str) -> DataFrame:
    found = series.resample(event_tables(spark, folder), "BROWN COAL", "1day", *CUT)
    return rounded(found.datapoints, MEAN_DIGITS, "mean_value")


@query
def list_series(spark: SparkSession, folder: str) -> DataFrame:
    return as_text(series.list_series(event_tables(spark, folder)), *FLAGS)


@query
def list_series_page(spark: SparkSession, folder: str) -> DataFrame:
    page = series.list_series(event_tables(spark, folder), page=1, per_page=8)
    return as_text(page, *FLAGS)


@query
def list_series_after(spark: SparkSession, folder: str) -> DataFrame:
    page = series.list_series_after(event_tables(spark, folder), after=8, per_page=8)
    return as_text(page, *FLAGS)


@query
def get_series(spark: SparkSession, folder: str) -> DataFrame:
    found = series.get_series(event_tables(spark, folder), "SMARD_Market_Price")
    return as_text(found, *FLAGS)


@query
def series_with_samples(spark: SparkSession, folder: str) -> DataFrame:
    return as_text(series.series_with_samples(event_tables(spark, folder)), *FLAGS)


@query
def series_extent(spark: SparkSession, folder: str) -> DataFrame:
    return series.series_extent(event_tables(spark, folder).ts)


# --- indicators ------------------------------------------------------------------------


def indicator(function: Callable[..., DataFrame], *args: str, values: tuple = ("value",)) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = function(event_tables(spark, folder), *args)
        return rounded(result, TOTAL_DIGITS if "name" in result.columns else ROW_DIGITS, *values)

    return run


for _name in ["total_consumption", "total_production", "self_consumption", "autarky", "cost_savings"]:
    add(_name, indicator(getattr(kpi, _name), *ALL))
    add(f"{_name}_ranged", indicator(getattr(kpi, _name), *CUT))
for _name in [
    "consumption_by_carrier",
    "local_consumption",
    "scope_one_emissions",
    "scope_two_emissions",
    "total_co2_emissions",
    "co2_savings",
    "total_grid_electricity_cost",
]:
    add(_name, indicator(getattr(kpi, _name), "1hour", *ALL))
    add(f"{_name}_monthly", indicator(getattr(kpi, _name), "1month", *ALL))
    add(f"{_name}_ranged", indicator(getattr(kpi, _name), "1day", *CUT))
for _name in ["grid_consumption", "local_production"]:
    _values = ("bucket_consumption", "carrier_proportion")
    add(_name, indicator(getattr(kpi, _name), "1hour", *ALL, values=_values))
    add(f"{_name}_ranged", indicator(getattr(kpi, _name), "1day", *CUT, values=_values))


BY_SERIES = {
    "total_consumption": (), "total_production": (), "self_consumption": (), "autarky": (), "cost_savings": (),
    "consumption_by_carrier": ("1hour",), "local_consumption": ("1hour",), "scope_one_emissions": ("1hour",),
    "scope_two_emissions": ("1hour",), "total_co2_emissions": ("1hour",), "co2_savings": ("1hour",),
    "total_grid_electricity_cost": ("1hour",), "grid_consumption": ("1hour",), "local_production": ("1hour",),
}


def by_series(name: str, *args: str) -> Query:
    """The indicator with one window per series; all other queries weigh by chunks of time."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = getattr(kpi, name)(event_tables(spark, folder, "series"), *args, *ALL)
        values = [c for c in ("value", "bucket_consumption", "carrier_proportion") if c in result.columns]
        return rounded(result, TOTAL_DIGITS if "name" in result.columns else ROW_DIGITS, *values)

    return run


for _name, _args in BY_SERIES.items():
    add(f"{_name}_by_series", by_series(_name, *_args))


def without_mix(function: Callable[..., DataFrame]) -> Query:
    """The indicator where the grid mix adds up to zero in every other hour."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = event_tables(spark, folder)
        zero = F.col("meta_id").between(8, 18) & (F.hour("series_timestamp") % 2 == 0)
        ts = t.ts.withColumn("series_value", F.when(zero, 0.0).otherwise(F.col("series_value")))
        result = function(replace(t, ts=ts), "1hour", *ALL, on_zero="null")
        return rounded(result, TOTAL_DIGITS if "name" in result.columns else ROW_DIGITS, "value")

    return run


for _name in ("consumption_by_carrier", "scope_two_emissions", "total_co2_emissions", "co2_savings"):
    add(f"{_name}_without_mix", without_mix(getattr(kpi, _name)))


@query
def total_consumption_chunked(spark: SparkSession, folder: str) -> DataFrame:
    t = event_tables(spark, folder, "chunked")
    return rounded(kpi.total_consumption(t, *ALL), TOTAL_DIGITS, "value")


@query
def co2_savings_chunked(spark: SparkSession, folder: str) -> DataFrame:
    t = event_tables(spark, folder, "chunked")
    return rounded(kpi.co2_savings(t, "1hour", *ALL), TOTAL_DIGITS, "value")


@query
def co2_savings_own_factors(spark: SparkSession, folder: str) -> DataFrame:
    t = event_tables(spark, folder)
    saved = kpi.co2_savings(t, "1hour", *ALL, actual="production")
    return rounded(saved, TOTAL_DIGITS, "value")


@query
def scope_two_emissions_weighted(spark: SparkSession, folder: str) -> DataFrame:
    t = event_tables(spark, folder)
    emitted = kpi.scope_two_emissions(t, "1hour", *ALL, apply_factor=True)
    return rounded(emitted, ROW_DIGITS, "value")


# --- emission factors ------------------------------------------------------------------


def carrier_of_part() -> Column:
    """A carrier name per part size; one in sixteen is not registered."""
    names = F.array(*(F.lit(name) for name in [*CARRIER_NAMES, "fusion"]))
    return F.element_at(names, (F.col("p_size") % 16 + 1).cast("int"))


def factor_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        carrier_of_part().alias("carrier"),
        (F.col("p_retailprice") / 1000).alias("factor"),
        F.lit("kgco2eq/kwh").alias("unit"),
        F.concat_ws("/", "p_brand", "p_size").alias("source"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("source_url"),
    )


def factor_table(spark: SparkSession, folder: str) -> DataFrame:
    """The default factors and one per part."""
    seeds = seed_factors(spark)
    added = new_factors(factor_requests(spark, folder), seeds, seed_carriers(spark))
    return seeds.unionByName(added)


def factor_tables(spark: SparkSession, folder: str) -> Tables:
    t = event_tables(spark, folder)
    return Tables(t.ts, t.meta, t.carriers, factor_table(spark, folder))


@query
def add_emission_factors(spark: SparkSession, folder: str) -> DataFrame:
    """The rows a batch of requests appends."""
    return new_factors(
        factor_requests(spark, folder), seed_factors(spark), seed_carriers(spark)
    ).drop("id")


@query
def appended_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of appended rows: one each and without gaps."""
    return factor_table(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("first"),
        F.max("id").alias("last"),
    )


@query
def emission_factors(spark: SparkSession, folder: str) -> DataFrame:
    return list_factors(factor_tables(spark, folder)).drop("id")


@query
def rejected_emission_factors(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_factors(factor_requests(spark, folder), seed_carriers(spark))


@query
def emission_factors_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return list_factors(factor_tables(spark, folder), source="Brand#12/19").drop("id")


@query
def emission_factors_by_carrier(spark: SparkSession, folder: str) -> DataFrame:
    return list_factors(factor_tables(spark, folder), carrier="gas").drop("id")


def many_factors(spark: SparkSession, folder: str) -> Tables:
    """Every part as a factor of one source."""
    t = event_tables(spark, folder)
    requests = factor_requests(spark, folder).withColumn("source", F.lit("parts"))
    added = new_factors(requests, t.factors, t.carriers)
    return Tables(t.ts, t.meta, t.carriers, t.factors.unionByName(added))


@query
def co2_savings_many_factors(spark: SparkSession, folder: str) -> DataFrame:
    saved = kpi.co2_savings(many_factors(spark, folder), "1hour", *ALL, source="parts")
    return rounded(saved, TOTAL_DIGITS, "value")


@query
def scope_one_emissions_many_factors(spark: SparkSession, folder: str) -> DataFrame:
    t = many_factors(spark, folder)
    emitted = kpi.scope_one_emissions(t, "1month", *ALL, source="parts")
    return rounded(emitted, TOTAL_DIGITS, "value")


@query
def scope_two_emissions_many_factors(spark: SparkSession, folder: str) -> DataFrame:
    t = many_factors(spark, folder)
    emitted = kpi.scope_two_emissions(t, "1month", *ALL, source="parts")
    return rounded(emitted, TOTAL_DIGITS, "value")


@query
def emission_factor_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Averages over the default factors and those of the parts."""
    base = seed_factors(spark, averaged=False)
    added = new_factors(factor_requests(spark, folder), base, seed_carriers(spark))
    means = average_factors(base.unionByName(added), seed_carriers(spark))
    return means.withColumn("factor", F.round("factor", 6))


@query
def source_fallback(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("source")
    )
    return resolve_sources(requests, factor_table(spark, folder))


# --- registering and ingest ------------------------------------------------------------


def part_series(spark: SparkSession, folder: str) -> DataFrame:
    """A series definition per part; names repeat, partly in another case."""
    name = F.concat_ws(" ", "p_name", "p_brand")
    local = F.when(F.col("p_size") % 3 == 1, True).when(F.col("p_size") % 3 == 2, False)
    return table(spark, folder, "part").select(
        F.when(F.col("p_size") > 25, F.upper(name)).otherwise(name).alias("identifier"),
        F.col("p_type").alias("unit"),
        carrier_of_part().alias("carrier"),
        (F.col("p_retailprice") > 1000).alias("consumption"),
        F.col("p_name").alias("description"),
        local.alias("local"),
        F.col("p_partkey").cast("long").alias("position"),
    )


def economy_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The sample registry and every economy part, as imported before."""
    economy = part_series(spark, folder).filter(F.col("unit") == "ECONOMY")
    return registry.registered_series(economy, sample_registry(spark), seed_carriers(spark))


@query
def register_series(spark: SparkSession, folder: str) -> DataFrame:
    known = economy_registry(spark, folder)
    after = registry.registered_series(part_series(spark, folder), known, seed_carriers(spark))
    return as_text(after, *FLAGS, "carrier")


@query
def resolve_series(spark: SparkSession, folder: str) -> DataFrame:
    """Each input with the attributes of the registry row it stands for."""
    meta = economy_registry(spark, folder)
    inputs = registry.normalised(part_series(spark, folder)).select("identifier", "unit")
    rows = meta.select(F.col("id").alias("meta_id"), F.col("identifier").alias("registered"))
    return registry.resolved(inputs, meta).join(rows, "meta_id", "left").drop("meta_id")


@query
def add_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = registry.added_series(
        part_series(spark, folder), sample_registry(spark), seed_carriers(spark)
    )
    return as_text(rows, *FLAGS, "carrier")


@query
def append_series(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct parts are appended to a stored registry and read back."""
    place, carriers = shared_folder(spark, "registry"), seed_carriers(spark)
    registry.append_rows(sample_registry(spark), place)
    single = part_series(spark, folder).withColumn("identifier", F.concat_ws(" ", "identifier", "position"))
    registry.append_series(single, place, carriers)
    stored = registry.read_registry(spark, place)
    stamped = F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()
    return as_text(stored.withColumn("stamped", stamped).drop(*registry.AUDIT), *FLAGS, "carrier", "stamped")


@query
def append_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of known carriers are appended to stored factors and listed with both stamps."""
    place, t = shared_folder(spark, "factors"), event_tables(spark, folder)
    known = factor_requests(spark, folder).filter(F.col("carrier") != "fusion")
    append_stored_factors(known, place, t.carriers)
    listed = list_factors(Tables(t.ts, t.meta, t.carriers, read_factors(spark, place)))
    stamped = F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()
    return as_text(listed.withColumn("stamped", stamped).drop("id", "created_at", "updated_at"), "stamped")


@query
def refused_series(spark: SparkSession, folder: str) -> DataFrame:
    return registry.refused_series(part_series(spark, folder), economy_registry(spark, folder))


@query
def unpivot_import(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of wide rows in long form; one column is no number, one does not exist."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_absent"]
    cells = wide_csv.unpivot_wide(table(spark, folder, "lineitem"), "l_shipdate", columns)
    return cells.select("time", "column", number_or_zero(F.col("raw")).alias("value"))


@query
def lenient_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Text with and without a number."""
    text = F.concat(F.col("value").cast("string"), F.substring("event_type", 1, 1))
    plain = F.col("value").cast("string")
    return table(spark, folder, "events").select(
        "event_id",
        number_or_zero(F.when(F.col("event_type") == "error", text).otherwise(plain)).alias("value"),
    )


@query
def parse_times(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
    parsed = table(spark, folder, "orders").select(
        "o_orderkey", wide_csv.time_of(text).alias("series_timestamp")
    )
    return without_zone(parsed, "series_timestamp")


@query
def wide_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written as a wide export, with line breaks in a quoted field, and read again."""
    place = shared_folder(spark, "wide")
    time = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
    note = F.concat(F.lit('first "line",\nsecond '), F.col("l_returnflag"))
    lines = table(spark, folder, "lineitem").select(
        time.alias("Time"), note.alias("note"), "l_quantity", F.col("l_tax").alias("l tax")
    )
    lines.write.option("header", True).option("escape", '"').csv(place)
    wide = wide_csv.read_wide(spark, place, line_breaks=True)
    cells = wide_csv.unpivot_wide(wide, "Time", ["l_quantity", "l tax", "absent"])
    rows = cells.select(
        wide_csv.time_of(F.col("time")).alias("series_timestamp"),
        "column",
        number_or_zero(F.col("raw")).alias("value"),
    )
    return without_zone(rows, "series_timestamp")


@query
def technology_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parts written as the cost files of two years and read again."""
    place = shared_folder(spark, "costs")
    parts = table(spark, folder, "part")
    for year in (2020, 2025):
        own = parts.filter(F.col("p_size") % 2 == year % 2)
        own.select(
            F.col("p_name").alias("technology"),
            F.col("p_brand").alias("parameter"),
            F.col("p_retailprice").alias("value"),
            F.col("p_type").alias("unit"),
        ).write.option("header", True).csv(f"{place}/{year}")
    return technology.read_all_costs(spark, f"{place}/%d", [2020, 2025])


@query
def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A scan written as JSON lines, as text."""
    place, t = shared_folder(spark, "lines"), event_tables(spark, folder)
    scan = series.series_scan(t, "total_load", *ALL).datapoints
    json_lines.write_json(scan.select("id", "timestamp", "value"), place)
    text = spark.read.text(place)
    return text.select(
        F.get_json_object("value", "$.id").alias("id"),
        F.substring(F.get_json_object("value", "$.timestamp"), 1, 26).alias("at"),
        F.right(F.get_json_object("value", "$.timestamp"), F.lit(1)).alias("zone"),
    )


@query
def result_document(spark: SparkSession, folder: str) -> DataFrame:
    """A scan with its registry row written as one nested document in parts, and read again."""
    place, t = shared_folder(spark, "document"), event_tables(spark, folder)
    found = series.series_scan(t, "total_load", *ALL)
    json_lines.write_document(found.datapoints.select("id", "timestamp", "value"), found.meta, place)
    points_ = json_lines.read_document(spark, place, "id long, timestamp timestamp, value double")
    return without_zone(points_, "timestamp")


def event_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON body per event; some identifiers are unknown or of another case."""
    names = F.array(*(F.lit(row[0]) for row in SAMPLE_SERIES))
    name = F.element_at(names, series_of_event())
    identifier = (
        F.when(F.col("event_type") == "error", F.upper(name))
        .when(F.col("event_type") == "signup", F.lit("unknown"))
        .otherwise(name)
    )
    point = F.struct(
        rfc_3339(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("value"),
        identifier.alias("identifier"),
    )
    return table(spark, folder, "events").select(
        F.to_json(F.struct(F.array(point).alias("timeseries"))).alias("body")
    )


@query
def ingest_points(spark: SparkSession, folder: str) -> DataFrame:
    parsed = points.parse_points(event_bodies(spark, folder))
    return without_zone(points.resolve_points(parsed, sample_registry(spark)), "series_timestamp")


@query
def point_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same bodies landed as lines and read again."""
    place = shared_folder(spark, "bodies")
    event_bodies(spark, folder).write.text(place)
    parsed = points.parse_points(points.read_bodies(spark, place, lines=True))
    return without_zone(points.resolve_points(parsed, sample_registry(spark)), "series_timestamp")


def shipped(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("meta_id"),
        F.col("l_shipdate").alias("series_timestamp"),
        F.col("l_quantity").alias("series_value"),
    )


def ordered(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("meta_id"),
        F.col("o_orderdate").alias("series_timestamp"),
        F.col("o_totalprice").alias("series_value"),
    )


@query
def ingest_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return samples.duplicate_samples(shipped(spark, folder), ordered(spark, folder))


@query
def ingest_new_only(spark: SparkSession, folder: str) -> DataFrame:
    return samples.new_samples(shipped(spark, folder), ordered(spark, folder))


@query
def unnest_arrays(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.array("o_orderdate", F.date_trunc("year", "o_orderdate").cast("timestamp_ntz")).alias(
            "timestamps"
        ),
        F.array(F.col("o_totalprice"), F.lit(0.0)).alias("values"),
        F.array(F.col("o_custkey").cast("int"), F.lit(0)).alias("meta_ids"),
    )
    return samples.unnest_samples(rows)


@query
def market_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Price files rebuilt from events: one pair per file, some without a price."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    price = F.when(F.col("event_type") != "error", F.col("value").cast("string"))
    files = table(spark, folder, "events").select(
        F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("chunk"),
        F.format_string('{"series":[[%s,%s]]}', at, F.coalesce(price, F.lit("null"))).alias("body"),
        "event_type",
    )
    chunks = files.select(
        "chunk", F.from_json("body", prices.CHUNK_SCHEMA)["series"].alias("series")
    )
    index = files.filter(F.col("event_type") == "purchase").select("chunk")
    wanted = prices.wanted_chunks(
        chunks, index, after="2024-01-04T00:00:00Z", before="2024-01-21T00:00:00Z"
    )
    return without_zone(prices.price_points(wanted), "series_timestamp")


@query
def price_increment(spark: SparkSession, folder: str) -> DataFrame:
    t = event_tables(spark, folder)
    price_id = t.meta.filter(named(MARKET_PRICE)).first().id
    mark = prices.high_water_mark(in_range(t.ts, *time_span(*CUT)), price_id)
    quotes = t.ts.filter(F.col("meta_id") == price_id)
    return prices.increment(quotes.select("series_timestamp", "series_value"), mark)


@query
def technology_filter(spark: SparkSession, folder: str) -> DataFrame:
    costs = table(spark, folder, "part").select(
        F.col("p_name").alias("technology"),
        F.col("p_brand").alias("parameter"),
        F.col("p_retailprice").alias("value"),
        F.col("p_type").alias("unit"),
        F.lit(2025).alias("year"),
    )
    return technology.filter_costs(costs, parameter="Brand#12", unit="ECONOMY")


# --- streams ---------------------------------------------------------------------------


def sample_stream(spark: SparkSession, folder: str, place: str) -> DataFrame:
    """Samples landed as several files in no order of time, one file a batch."""
    events = table(spark, folder, "events")
    events.repartition(4, F.xxhash64("event_id")).write.mode("overwrite").parquet(f"{place}/landing")
    landed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    rows = event_samples(landed.parquet(f"{place}/landing")).withColumn(
        "series_timestamp", F.col("series_timestamp").cast("timestamp")
    )
    return rows.select("meta_id", "series_timestamp", "series_value")


@query
def stream_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Every sample arrives twice and is stored once."""
    place = shared_folder(spark, "stream-prices")
    stream = sample_stream(spark, folder, place)
    twice = stream.unionByName(stream)
    price_stream.append_stream(twice, f"{place}/samples", f"{place}/state").awaitTermination()
    stored = samples.read_samples(spark, f"{place}/samples")
    return without_zone(
        stored.select("meta_id", "series_timestamp", "series_value"), "series_timestamp"
    )


@query
def stream_prices_watermarked(spark: SparkSession, folder: str) -> DataFrame:
    """The same by streaming state, without a table to compare with."""
    place = shared_folder(spark, "stream-unique")
    stream = sample_stream(spark, folder, place)
    written = (
        price_stream.without_repeats(stream.unionByName(stream))
        .writeStream.format("parquet")
        .option("path", f"{place}/samples")
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    written.awaitTermination()
    return without_zone(spark.read.parquet(f"{place}/samples"), "series_timestamp")


@query
def stream_resample(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_folder(spark, "stream-means")
    stream = sample_stream(spark, folder, place)
    mean_stream.log_means(stream, "1hour", f"{place}/log", f"{place}/state").awaitTermination()
    means = mean_stream.logged_means(spark, f"{place}/log")
    return without_zone(rounded(means, MEAN_DIGITS, "mean_value"), "bucket")


@query
def stream_resample_windowed(spark: SparkSession, folder: str) -> DataFrame:
    """The same by streaming state, open hours included."""
    place = shared_folder(spark, "stream-windows")
    stream = sample_stream(spark, folder, place)
    mean_stream.follow_means(stream, "1hour", f"{place}/log", f"{place}/state").awaitTermination()
    means = mean_stream.followed_means(spark, f"{place}/log")
    return without_zone(rounded(means, MEAN_DIGITS, "mean_value"), "bucket")


@query
def stream_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Every sample arrives twice and is logged once, without state; batches are merged."""
    place = shared_folder(spark, "stream-arrivals")
    stream = sample_stream(spark, folder, place)
    log = f"{place}/log"
    price_stream.log_arrivals(stream.unionByName(stream), log, f"{place}/state").awaitTermination()
    price_stream.compact_arrivals(spark, log)
    return without_zone(price_stream.arrivals(spark, log), "series_timestamp")


@query
def stream_resample_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Means of a log whose batches were merged."""
    place = shared_folder(spark, "stream-merged")
    stream = sample_stream(spark, folder, place)
    mean_stream.log_means(stream, "1hour", f"{place}/log", f"{place}/state").awaitTermination()
    mean_stream.compact_means(spark, f"{place}/log")
    means = mean_stream.logged_means(spark, f"{place}/log")
    return without_zone(rounded(means, MEAN_DIGITS, "mean_value"), "bucket")


@query
def stream_sample_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Weights from four batches that overlap by two hours, and a last one that closes all series."""
    place = shared_folder(spark, "stream-weights")
    rows = event_tables(spark, folder).ts.select(
        "id", "meta_id", F.col("series_timestamp").cast("timestamp").alias("series_timestamp"), "series_value"
    )
    shaken = F.unix_seconds("series_timestamp") + F.pmod(F.xxhash64("id"), F.lit(7200)) - 3600
    first, last = rows.agg(F.min("series_timestamp"), F.max("series_timestamp")).first()
    width = int((last - first).total_seconds()) // 4 + 1
    part = F.floor((shaken - F.unix_seconds(F.lit(first))) / width)
    rows = rows.withColumn("part", F.greatest(F.least(part, F.lit(3)), F.lit(0))).drop("id")
    beats = rows.groupBy("meta_id").agg(
        F.timestamp_seconds(F.lit(last.timestamp() + 86400)).alias("series_timestamp"),
        F.lit(None).cast("double").alias("series_value"),
        F.lit(4).cast("long").alias("part"),
    )
    rows = rows.withColumn("beat", F.lit(False)).unionByName(beats.withColumn("beat", F.lit(True)))
    for number in range(5):
        own = rows.filter(F.col("part") == number).drop("part")
        own.coalesce(1).write.mode("append").parquet(f"{place}/landing")
    landed = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1)
    weight_stream.weigh_stream(landed.parquet(f"{place}/landing"), f"{place}/log", f"{place}/state", "3hour").awaitTermination()
    weighed = weight_stream.weighed_stream(spark, f"{place}/log")
    return without_zone(weighed.select("meta_id", "series_timestamp", "hours", "late"), "series_timestamp")


# --- tables kept beside the samples ------------------------------------------------------

_stored: dict[tuple[str, str], tuple[str, Tables]] = {}


def stored_tables(spark: SparkSession, folder: str) -> Tables:
    """Events appended to a sample table in three parts, with extents, pages and hourly sums.

    They are written once per session, and again if their folder is gone.
    """
    key_ = (spark.sparkContext.applicationId, folder)
    if key_ not in _stored or not folder_names(spark, f"{_stored[key_][0]}/pages"):
        place, t = shared_folder(spark, "stored"), event_tables(spark, folder)
        rows = t.ts.select(
            "id", "meta_id", F.col("series_timestamp").cast("timestamp").alias("series_timestamp"), "series_value"
        )
        for part in range(3):
            batch = rows.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part).drop("id")
            samples.append_samples(batch, f"{place}/samples", extents=f"{place}/extents")
            hourly.refresh_hourly(spark, f"{place}/samples", f"{place}/hourly", hourly.touched_months(batch))
        registry.page_directory(t.meta, width=5).write.parquet(f"{place}/pages")
        t = Tables(
            samples.read_samples(spark, f"{place}/samples"),
            t.meta,
            t.carriers,
            t.factors,
            extents=extents.read_extents(spark, f"{place}/extents"),
            pages=spark.read.parquet(f"{place}/pages"),
            hourly=hourly.read_hourly(spark, f"{place}/hourly"),
        )
        _stored[key_] = place, t
    return _stored[key_][1]


def kept(function: Callable[..., DataFrame], *args: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = function(stored_tables(spark, folder), *args)
        columns = ("carrier_proportion", "bucket_consumption") if "bucket_consumption" in result.columns else ("value",)
        times = [c for c in ("bucket", "from_timestamp", "to_timestamp") if c in result.columns]
        digits = TOTAL_DIGITS if "name" in result.columns else ROW_DIGITS
        return without_zone(rounded(result, digits, *columns), *times)

    return run


HOURLY = {
    "total_consumption": (),
    "autarky": (),
    "cost_savings": (),
    "consumption_by_carrier": ("1hour",),
    "scope_two_emissions": ("1hour",),
    "co2_savings": ("1hour",),
    "total_co2_emissions": ("1hour",),
    "total_grid_electricity_cost": ("1hour",),
}
for _name, _interval in HOURLY.items():
    add(f"{_name}_hourly", kept(getattr(kpi, _name), *_interval, *ALL))
add("total_consumption_hourly_ranged", kept(kpi.total_consumption, *CUT))
add("consumption_by_carrier_hourly_ranged", kept(kpi.consumption_by_carrier, "1day", *CUT))


@query
def series_extent_kept(spark: SparkSession, folder: str) -> DataFrame:
    t = stored_tables(spark, folder)
    return without_zone(series.series_extent(t.ts, t.extents), "min_timestamp", "max_timestamp")


@query
def list_series_last_page(spark: SparkSession, folder: str) -> DataFrame:
    page = series.list_series(stored_tables(spark, folder), page=2, per_page=8)
    return without_zone(as_text(page, *FLAGS), "min_timestamp", "max_timestamp")


# --- large landed files ------------------------------------------------------------------


@query
def point_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document of points per day, each cut into its points by many tasks."""
    place = shared_folder(spark, "documents")
    point = F.from_json("body", points.BODY_SCHEMA)["timeseries"][0]
    rows = event_bodies(spark, folder).select(point.alias("point"))
    days = rows.groupBy(F.substring("point.timestamp", 1, 10).alias("day")).agg(F.collect_list("point").alias("timeseries"))
    days.select("day", F.to_json(F.struct("timeseries")).alias("body")).write.partitionBy("day").text(place)
    parsed = points.parse_points(points.split_bodies(spark, f"{place}/day=*"))
    return without_zone(points.resolve_points(parsed, sample_registry(spark)), "series_timestamp")


@query
def load_export(spark: SparkSession, folder: str) -> DataFrame:
    """A wide export loaded by a spec into an empty table; a second initial load does nothing."""
    place = shared_folder(spark, "export")
    time = F.timestamp_seconds(F.lit(1577836800) + F.col("event_id") * 60)
    table(spark, folder, "events").select(
        F.date_format(time, "yyyy-MM-dd HH:mm:ss+00:00").alias("Time"), F.col("value").alias("Value"), "user_id"
    ).write.option("header", True).csv(f"{place}/files")
    entry = {"unit": "kW", "carrier": "solar", "consumption": False, "description": "", "local": True}
    spec = wide_csv.parse_spec(
        {
            "time_column": "Time",
            "timeseries": [{"identifier": name, **entry} for name in ("Value", "user_id", "absent")],
            "files": [f"{place}/files"],
        }
    )
    stale = sample_registry(spark)
    for _ in range(2):
        wide_csv.load_wide(
            spark, spec, stale, seed_carriers(spark), f"{place}/samples", only_if_empty=True, registry_path=f"{place}/registry"
        )
    known = registry.read_registry(spark, f"{place}/registry").select(F.col("id").alias("meta_id"), "identifier", "unit")
    stored = samples.read_samples(spark, f"{place}/samples").join(known, "meta_id")
    return without_zone(stored.select("meta_id", "identifier", "unit", "series_timestamp", "series_value"), "series_timestamp")


@query
def default_range(spark: SparkSession, folder: str) -> DataFrame:
    """Without bounds a range runs from 1970 until now."""
    return rounded(kpi.total_consumption(event_tables(spark, folder)), TOTAL_DIGITS, "value").select("value", "name", "unit")
