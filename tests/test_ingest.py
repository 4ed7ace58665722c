"""Imports, registration, uniqueness, feeds and files."""

from __future__ import annotations

import json
import re
from datetime import datetime
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from conftest import at
from wattframe.operators import factors
from wattframe.sources import extents, hourly, points, prices, records, registry, samples, technology, wide_csv
from wattframe.sources.event_log import sample_registry
from wattframe.tables import META_SCHEMA, Tables, local_table, seed_carriers

# Failures in a task reach Python as one or the other.
FAILURES = (PySparkException, Py4JJavaError)
BATCH = T.StructType(
    [
        T.StructField("meta_id", T.IntegerType()),
        T.StructField("series_timestamp", T.TimestampType()),
        T.StructField("series_value", T.DoubleType()),
    ]
)
BODY = T.StructType([T.StructField("body", T.StringType())])


def entry(identifier, **changes):
    plain = {"unit": "kW", "carrier": "solar", "consumption": False, "description": identifier, "local": True}
    return {"identifier": identifier, **plain, **changes}


def write(path, text):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return str(path)


@pytest.fixture
def csv_files(folder):
    one = write(
        f"{folder}/2019.csv",
        "id,Time,Production,Brown Coal,odd.name\n"
        "1,2019-01-01 00:00:00+00:00,1.5,10,7\n"
        "2,2019-01-01 01:00:00+01:00,bad,,8\n"
        "3,2019-02-01 00:15:00+00:00,-2,1e2,9\n",
    )
    # the same columns in another order, and one less
    two = write(f"{folder}/2020.csv", "Brown Coal,Time\n5,2020-01-01 00:00:00+00:00\n")
    return [one, two]


def spec(files, *entries):
    return wide_csv.ImportSpec("Time", list(entries), files)


ENTRIES = [
    entry("Production"),
    entry("Brown Coal", unit="MWh", carrier="lignite", consumption=True, local=None),
    entry("odd.name"),
    entry("Nowhere"),
]


def test_wide_import(spark, folder, csv_files):
    files = [csv_files[0].replace("2019.csv", "2019.csv"), csv_files[1]]
    write(files[0], Path(files[0]).read_text().replace("01:00:00+01:00", "01:15:00+01:00"))
    loaded = wide_csv.load_wide(
        spark, spec(files, *ENTRIES), sample_registry(spark), seed_carriers(spark), f"{folder}/ts"
    )
    assert loaded.skipped == {files[0]: ["Nowhere"], files[1]: ["Production", "odd.name", "Nowhere"]}
    new = loaded.meta.filter("id > 21").orderBy("identifier").collect()
    assert [(r.identifier, r.unit, r.local, r.carrier) for r in new] == [
        ("odd.name", "kw", True, 6),
        ("production", "kw", True, 6),
    ]
    # brown coal is known already and keeps its id
    ids = {r.identifier: r.id for r in loaded.meta.collect()}
    assert sorted(r.id for r in new) == [22, 23] and ids["brown coal"] == 8
    stored = samples.read_samples(spark, f"{folder}/ts")
    found = {(r.meta_id, r.series_timestamp): r.series_value for r in stored.collect()}
    assert found == {
        (ids["production"], datetime(2019, 1, 1)): 1.5,
        (ids["production"], datetime(2019, 1, 1, 0, 15)): 0.0,
        (ids["production"], datetime(2019, 2, 1, 0, 15)): -2.0,
        (8, datetime(2019, 1, 1)): 10.0,
        (8, datetime(2019, 1, 1, 0, 15)): 0.0,
        (8, datetime(2019, 2, 1, 0, 15)): 100.0,
        (ids["odd.name"], datetime(2019, 1, 1)): 7.0,
        (ids["odd.name"], datetime(2019, 1, 1, 0, 15)): 8.0,
        (ids["odd.name"], datetime(2019, 2, 1, 0, 15)): 9.0,
        (8, datetime(2020, 1, 1)): 5.0,
    }
    assert stored.filter("created_at is null or id is null").count() == 0
    assert sorted(p.name for p in Path(folder, "ts").glob("month=*")) == [
        "month=2019-01-01", "month=2019-02-01", "month=2020-01-01",
    ]
    again = wide_csv.load_wide(
        spark, spec(files, *ENTRIES), loaded.meta, seed_carriers(spark), f"{folder}/ts", only_if_empty=True
    )
    assert again is None
    with pytest.raises(samples.DuplicateSamples):
        wide_csv.load_wide(spark, spec(files, *ENTRIES), loaded.meta, seed_carriers(spark), f"{folder}/ts")


def test_equal_times_in_one_file_fail(spark, folder, csv_files):
    """01:00+01:00 is 00:00+00:00 again."""
    with pytest.raises(FAILURES, match="repeated sample"):
        wide_csv.load_wide(
            spark, spec(csv_files, *ENTRIES), sample_registry(spark), seed_carriers(spark), f"{folder}/ts"
        )
    assert not samples.has_samples(samples.read_samples(spark, f"{folder}/ts"))


@pytest.mark.parametrize("time", ["2019-01-01 00:00:00", "2019-01-01T00:00:00+00:00", "2019-01-01 00:00:00Z", "x"])
def test_bad_times_fail(spark, folder, time):
    file = write(f"{folder}/a.csv", f"Time,Production\n{time},1\n")
    planned = wide_csv.import_wide(spark, spec([file], ENTRIES[0]), sample_registry(spark), seed_carriers(spark))
    with pytest.raises(FAILURES, match="not a timestamp"):
        planned.samples.collect()


def test_files_without_the_columns(spark, folder):
    file = write(f"{folder}/a.csv", "Time,other\n2019-01-01 00:00:00+00:00,1\n")
    args = sample_registry(spark), seed_carriers(spark)
    assert wide_csv.import_wide(spark, spec([file], ENTRIES[0]), *args).samples.count() == 0
    with pytest.raises(ValueError, match="no column"):
        wide_csv.import_wide(spark, wide_csv.ImportSpec("Zeit", ENTRIES, [file]), *args)


def test_quoted_headers(spark, folder):
    file = write(f"{folder}/a.csv", 'Time,"a ""b"", c"\n2019-01-01 00:00:00+00:00,"2"\n')
    spec_ = spec([file], entry('a "b", c'))
    planned = wide_csv.import_wide(spark, spec_, sample_registry(spark), seed_carriers(spark))
    assert [(r.meta_id, r.series_value) for r in planned.samples.collect()] == [(22, 2.0)]


def test_folders_must_share_a_header(spark, folder):
    write(f"{folder}/in/a.csv", "Time,Production\n2019-01-01 00:00:00+00:00,1\n")
    write(f"{folder}/in/b.csv", "Production,Time\n1,2019-01-02 00:00:00+00:00\n")
    planned = wide_csv.import_wide(
        spark, spec([f"{folder}/in"], ENTRIES[0]), sample_registry(spark), seed_carriers(spark)
    )
    with pytest.raises(FAILURES):
        planned.samples.collect()


def test_unregistered_carriers_and_missing_attributes_fail(spark, csv_files):
    args = sample_registry(spark), seed_carriers(spark)
    with pytest.raises(ValueError, match="Production"):
        wide_csv.import_wide(spark, spec(csv_files, entry("Production", carrier="fusion")), *args)
    with pytest.raises(FAILURES, match="lacks carrier, description"):
        bad = entry("Production", carrier=None, description=None)
        wide_csv.import_wide(spark, spec(csv_files, bad), *args)
    with pytest.raises(ValueError):
        registry.series_inputs(spark, [{"identifier": "a", "measure": "b"}])
    with pytest.raises(ValueError):
        registry.series_inputs(spark, [{"identifier": "a", "unit": "b", "carrier": 3}])


def test_specs(spark, folder):
    content = {"time_column": "Time", "timeseries": [entry("a")], "files": ["x.csv"]}
    expected = wide_csv.ImportSpec("Time", [entry("a")], ["x.csv"])
    assert wide_csv.parse_spec(json.dumps(content)) == expected
    assert wide_csv.read_spec(write(f"{folder}/s.json", json.dumps(content))) == expected
    assert wide_csv.read_spec(f"{folder}/s.json", spark) == expected
    pytest.importorskip("yaml")
    text = "files: [x.csv]\ntime_column: Time\ntimeseries:\n  - {identifier: a, unit: kW}\n"
    assert wide_csv.read_spec(write(f"{folder}/s.yaml", text)).timeseries == [{"identifier": "a", "unit": "kW"}]


def test_the_first_listed_is_registered(spark):
    entries = [entry("twice", carrier="solar", description="first"), entry("TWICE", unit="KW", carrier="coal", description="second"), entry("after")]
    meta = registry.registered_series(registry.series_inputs(spark, entries), sample_registry(spark), seed_carriers(spark))
    new = {r.identifier: (r.id, r.carrier, r.description) for r in meta.filter("id > 21").collect()}
    assert new == {"twice": (22, 6, "first"), "after": (23, 6, "after")}


def test_stored_registry_and_factors(spark, folder):
    carriers, path = seed_carriers(spark), f"{folder}/registry"
    sent = registry.series_inputs(spark, [{"identifier": "One", "unit": "kW"}, {"identifier": "two", "unit": "kW", "carrier": "gas"}])
    assert sorted(r.id for r in registry.append_series(sent, path, carriers).collect()) == [1, 2]
    again = registry.series_inputs(spark, [{"identifier": "new", "unit": "kW"}, {"identifier": "ONE", "unit": "kw"}])
    with pytest.raises(registry.RefusedSeries):
        registry.append_series(again, path, carriers)
    stored = registry.read_registry(spark, path)
    assert stored.count() == 2 and stored.filter("created_at is null or updated_at is null").count() == 0
    kind = "carrier string, factor double, unit string, source string, source_url string"
    rows = spark.createDataFrame([("gas", 0.5, "u", "s", None), ("coal", 0.9, "u", "s", "x")], kind)
    assert sorted(r.id for r in factors.append_factors(rows, f"{folder}/factors", carriers).collect()) == [1, 2]
    with pytest.raises(ValueError, match="fusion"):
        factors.append_factors(spark.createDataFrame([("fusion", 1.0, "u", "s", None)], kind), f"{folder}/factors", carriers)
    stored = factors.read_factors(spark, f"{folder}/factors")
    listed = factors.list_factors(Tables(None, None, carriers, stored))
    assert listed.count() == 2 and {"created_at", "updated_at"} <= set(listed.columns)


def test_import_registers_before_it_stores(spark, folder):
    file = write(f"{folder}/a.csv", 'Time,Production,note\n2019-01-01 00:00:00+00:00,1,"two\nlines"\n')
    carriers, path = seed_carriers(spark), f"{folder}/registry"
    plan = wide_csv.ImportSpec("Time", [ENTRIES[0]], [file], line_breaks=True)
    empty = registry.read_registry(spark, path)
    loaded = wide_csv.load_wide(spark, plan, empty, carriers, f"{folder}/ts", registry_path=path)
    assert [(r.id, r.identifier) for r in loaded.meta.collect()] == [(1, "production")]
    assert [r.meta_id for r in samples.read_samples(spark, f"{folder}/ts").collect()] == [1]
    with pytest.raises(FAILURES):
        wide_csv.load_wide(spark, wide_csv.ImportSpec("Time", [ENTRIES[0]], [file]), empty, carriers, f"{folder}/other")


def test_adding_series(spark):
    sent = registry.series_inputs(
        spark,
        [
            {"identifier": "Mixed Case", "unit": "kW"},
            {"identifier": "b", "unit": "u", "carrier": "fusion", "consumption": True},
            {"identifier": "TOTAL_LOAD", "unit": "KW", "carrier": "solar"},
        ],
    )
    meta, carriers = sample_registry(spark), seed_carriers(spark)
    rows = {r.identifier: r for r in registry.added_series(sent, meta, carriers).collect()}
    assert sorted(r.id for r in rows.values()) == [22, 23, 24]
    assert (rows["Mixed Case"].carrier, rows["b"].carrier, rows["b"].carrier_name) == (None, None, "fusion")
    refused = registry.refused_series(sent, meta).collect()
    assert [(r.identifier, r.sent, r.held) for r in refused] == [("total_load", 1, 1)]


# --- the sample table ------------------------------------------------------------------


def batch(spark, *rows):
    return local_table(spark, [(s, at(m), float(v)) for s, m, v in rows], BATCH)


def test_append_and_skip(spark, folder):
    path = f"{folder}/ts"
    samples.append_samples(batch(spark, (1, 0, 1), (2, 0, 2)), path)
    with pytest.raises(samples.DuplicateSamples):
        samples.append_samples(batch(spark, (1, 5, 1), (2, 0, 9)), path)
    with pytest.raises(FAILURES, match="repeated sample"):
        samples.append_samples(batch(spark, (1, 5, 1), (1, 5, 1)), path)
    assert samples.read_samples(spark, path).count() == 2
    samples.append_samples(batch(spark, (1, 0, 7), (1, 5, 4), (1, 5, 3)), path, "skip")
    found = {(r.meta_id, r.series_timestamp): r.series_value for r in samples.read_samples(spark, path).collect()}
    assert found == {(1, at(0)): 1.0, (2, at(0)): 2.0, (1, at(5)): 3.0}
    for how in ("skip", "error"):
        with pytest.raises(FAILURES, match="without a series"):
            samples.append_samples(batch(spark, (None, 0, 1), (3, 0, 1)), path, how)
    stored = samples.read_samples(spark, path)
    assert stored.count() == stored.select("id", "series_timestamp").distinct().count() == 3
    base = spark.conf.get("spark.checkpoint.dir")
    assert not list(Path(base).glob("batch-*"))
    with pytest.raises(ValueError):
        samples.append_samples(batch(spark), path, "replace")


def test_only_touched_months_and_series_are_compared(spark, folder):
    path = f"{folder}/ts"
    days = [(1, 0, 1), (2, 0, 2), (1, -60 * 24 * 40, 3), (1, -60 * 24 * 400, 4)]
    samples.append_samples(batch(spark, *days), path)
    new = batch(spark, (1, 5, 1), (1, -60 * 24 * 401, 1))
    kept = samples.touched_rows(samples.read_samples(spark, path), new)
    assert sorted(r.series_value for r in kept.collect()) == [1.0, 4.0]
    samples.append_samples(new, path)
    assert samples.read_samples(spark, path).count() == 6
    assert samples.touched_rows(samples.read_samples(spark, path), new.limit(0)).count() == 0


def test_duplicate_report(spark):
    new, old = batch(spark, (1, 0, 1), (1, 0, 2), (2, 0, 1), (3, 0, 1)), batch(spark, (2, 0, 5))
    rows = samples.duplicate_samples(new, old).orderBy("meta_id").collect()
    assert [(r.meta_id, r.copies, r.stored) for r in rows] == [(1, 2, False), (2, 1, True)]


def test_a_hot_series_is_spread_over_ranges(spark, folder):
    """Most rows belong to one series and month; ranges split them, sorted."""
    rows = spark.range(20000).select(
        F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("meta_id"),
        F.timestamp_seconds(F.col("id") + 1700000000).alias("series_timestamp"),
        F.col("id").cast("double").alias("series_value"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        form = samples.stored_form(rows).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in form.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 20000 / 8


def test_parallel_arrays(spark):
    df = spark.sql("SELECT array(timestamp'2024-01-10 00:00:00') timestamps, array(2D, 3D) values, array(1, 4) meta_ids")
    rows = samples.unnest_samples(df).collect()
    assert [(r.meta_id, r.series_value) for r in rows] == [(1, 2.0), (4, 3.0)]
    assert rows[1].series_timestamp is None


# --- feeds and files -------------------------------------------------------------------


def test_points(spark, folder):
    body = {
        "timeseries": [
            {"timestamp": "2023-07-04T08:00:00Z", "value": 17, "identifier": "total_load"},
            {"timestamp": "2023-07-04T08:00:00+01:00", "value": 1.5, "identifier": "Total_Load"},
            {"timestamp": "2023-07-04T08:00:01.25Z", "value": 2, "identifier": "unknown", "more": 1},
            {"timestamp": "2023-07-04T08:00:02Z", "value": 7, "identifier": "hard coal"},
        ]
    }
    write(f"{folder}/in/a.json", json.dumps(body, indent=1))
    parsed = points.parse_points(points.read_bodies(spark, f"{folder}/in"))
    assert parsed.count() == 4
    rows = points.resolve_points(parsed, sample_registry(spark)).orderBy("meta_id").collect()
    assert [tuple(r) for r in rows] == [
        (5, datetime(2023, 7, 4, 8), 17.0),
        (9, datetime(2023, 7, 4, 8, 0, 2), 7.0),
    ]


@pytest.mark.parametrize(
    "body",
    [
        '{"timestamp": "2023-07-04T08:00:00Z", "value": 17, "series": "a"}',
        '{"timeseries": [{"timestamp": "2023-07-04T08:00:00Z", "value": 17, "series": "a"}]}',
        '{"timeseries": [{"timestamp": "2023-07-04", "value": 42, "identifier": "a"}]}',
        '{"timeseries": [{"timestamp": "2023-07-04T08:00:00Z", "value": null, "identifier": "a"}]}',
        '{"timeseries": [{"timestamp": "2023-07-04T08:00:00Z", "value": "x", "identifier": "a"}]}',
        "not json",
    ],
)
def test_bad_bodies_fail(spark, body):
    with pytest.raises(FAILURES):
        points.parse_points(local_table(spark, [(body,)], BODY)).collect()


def test_of_several_units_points_take_the_lowest_id(spark):
    rows = [(7, "a", "kw", None, None, None, None, 0), (3, "a", "mw", None, None, None, None, 0)]
    body = '{"timeseries": [{"timestamp": "2023-07-04T08:00:00Z", "value": 1, "identifier": "a"}]}'
    parsed = points.parse_points(local_table(spark, [(body,)], BODY))
    assert points.resolve_points(parsed, local_table(spark, rows, META_SCHEMA)).first().meta_id == 3


def millis(*day):
    return int(datetime(*day).timestamp() * 1000)


def test_price_files(spark, folder):
    starts = [millis(2019, 1, 1), millis(2019, 6, 3), millis(2020, 12, 28), millis(2021, 1, 1)]
    write(f"{folder}/index/index_hour.json", json.dumps({"timestamps": starts}))
    for start in [*starts, millis(2019, 7, 1)]:
        series = [[start, 1.25], [start + 3600000, None], [start + 7200000, -3]]
        write(f"{folder}/chunks/4169_DE_hour_{start}.json", json.dumps({"series": series}, indent=2))
    write(f"{folder}/chunks/1_DE_hour_{starts[1]}.json", json.dumps({"series": [[0, 0]]}))
    chunks = prices.read_chunks(spark, f"{folder}/chunks")
    assert chunks.count() == 5
    wanted = prices.wanted_chunks(chunks, prices.read_index(spark, f"{folder}/index"))
    rows = prices.price_points(wanted).orderBy("series_timestamp").collect()
    assert [tuple(r) for r in rows] == [
        (datetime(2019, 6, 3), 1.25),
        (datetime(2019, 6, 3, 2), -3.0),
        (datetime(2020, 12, 28), 1.25),
        (datetime(2020, 12, 28, 2), -3.0),
    ]
    assert [r.unpriced for r in prices.unpriced_points(wanted).collect()] == [1, 1]


def test_high_water_mark(spark):
    stored = batch(spark, (21, 0, 1), (21, 30, 1), (5, 90, 1))
    mark = prices.high_water_mark(stored, 21)
    assert mark.replace(tzinfo=None) == at(30)
    new = batch(spark, (21, 30, 1), (21, 30.5, 1), (21, 0, 1))
    assert [r.series_timestamp for r in prices.increment(new, mark).collect()] == [at(30.5)]
    assert prices.increment(new, prices.high_water_mark(stored, 1)).count() == 3


def test_technology_costs(spark, folder):
    head = "technology,parameter,value,unit,source\n"
    write(f"{folder}/costs_2020.csv", head + "coal,efficiency,0.35,p.u.,a\nsolar,FOM,1.9,%/year,b\n")
    write(f"{folder}/costs_2025.csv", head + "coal,efficiency,0.36,p.u.,a\n")
    pattern = f"{folder}/costs_%d.csv"
    both = technology.read_all_costs(spark, pattern, [2020, 2025])
    assert technology.filter_costs(both).columns == [*technology.COLUMNS, "source", "year"]
    found = technology.filter_costs(both, parameter="efficiency", technology="coal")
    assert found.columns == technology.COLUMNS
    assert sorted(r.value for r in found.collect()) == [0.35, 0.36]
    assert technology.filter_costs(both, value=1.9).count() == 1
    with pytest.raises(ValueError):
        technology.filter_costs(both, year=2020)
    with pytest.raises(ValueError):
        technology.read_costs(spark, 2021, pattern)


def test_bad_numbers_of_costs_fail(spark, folder):
    write(f"{folder}/costs_2020.csv", "technology,parameter,value,unit\ncoal,a,,b\ncoal,a,1e3,b\n")
    assert [r.value for r in technology.read_costs(spark, 2020, f"{folder}/costs_%d.csv").collect()] == [None, 1000.0]
    write(f"{folder}/costs_2025.csv", "technology,parameter,value,unit\ncoal,a,many,b\n")
    with pytest.raises(FAILURES, match="not a number"):
        technology.read_costs(spark, 2025, f"{folder}/costs_%d.csv").collect()


# --- large files ------------------------------------------------------------------------


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def quoted_lines(n, rng):
    """Lines with breaks, quotes and commas inside quotes, some of them longer than a range."""
    out = ['Time,"a ""b""\nc",note']
    for k in range(n):
        note = rng.choice(["plain", "", "x" * 700, 'two ""quotes""', "line\nbreak", "\n\n", 'a"",\n""b', ",\r\n,"])
        out.append(f'2019-01-01 {k // 60:02}:{k % 60:02}:00+00:00,{k},"{note}"')
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, folder, small_ranges, ends):
    import random

    text = quoted_lines(120, random.Random(3)).replace("\r\n", "\n").replace("\n", ends)
    Path(f"{folder}/in").mkdir()
    for name in ("a.csv", "b.csv"):
        Path(f"{folder}/in/{name}").write_bytes(text.encode())
    split = wide_csv.read_wide(spark, f"{folder}/in", line_breaks=True)
    plain = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(f"{folder}/in")
    )
    assert split.columns == plain.columns == ["Time", 'a "b"\nc', "note"]
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert records._pieces(spark, f"{folder}/in", "\n", records.quote_count).select("file", "range").distinct().count() > 40


def test_records_keep_their_order_and_unclosed_quotes_fail(spark, folder, small_ranges):
    write(f"{folder}/one.txt", 'a"b\n' * 301 + "c\n")
    with pytest.raises(FAILURES, match="not closed"):
        records.records(spark, f"{folder}/one.txt").collect()
    write(f"{folder}/two.txt", "".join(f'{k}"\n"\n' for k in range(500)) + "end")
    rows = records.records(spark, f"{folder}/two.txt").orderBy("range", "place").collect()
    assert [r.record for r in rows] == [f'{k}"\n"' for k in range(500)] + ["end"]
    assert [r.first for r in rows] == [True] + [False] * 500
    write(f"{folder}/none.txt", "")
    assert records.records(spark, f"{folder}/none.txt").collect() == []


def test_another_header_fails(spark, folder):
    write(f"{folder}/in/a.csv", "Time,a\n2019-01-01 00:00:00+00:00,1\n")
    write(f"{folder}/in/b.csv", "Time,b\n2019-01-01 00:00:00+00:00,1\n")
    with pytest.raises(FAILURES, match="another header"):
        wide_csv.read_wide(spark, f"{folder}/in", line_breaks=True).collect()


def points_of(n):
    names = ["a", "b } c", 'quo"te', "back\\slash", "{[", "é\\"]
    return [{"timestamp": "2023-07-04T08:00:00Z", "value": k, "identifier": names[k % len(names)]} for k in range(n)]


@pytest.mark.parametrize("indent, end", [(None, ""), (1, "\n"), (None, " \n\n")])
def test_large_documents_are_read_by_many_tasks(spark, folder, small_ranges, indent, end):
    for name, n in (("a", 200), ("b", 1), ("c", 0)):
        write(f"{folder}/in/{name}.json", json.dumps({"timeseries": points_of(n)}, indent=indent, ensure_ascii=False) + end)
    split = points.parse_points(points.split_bodies(spark, f"{folder}/in"))
    whole = points.parse_points(points.read_bodies(spark, f"{folder}/in"))
    assert split.count() == 201
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize(
    "change",
    [
        lambda text: text[:-1],  # no closing brace
        lambda text: text[:-2],
        lambda text: text + "}",
        lambda text: text + " x",
        lambda text: text + text,
        lambda text: text[:400] + text[401:] if text[400] in '{",}' else text[:text.index("},") + 1] + text[text.index("},") + 2 :],
        lambda text: text.replace('"timeseries"', '"series"'),
        lambda text: text.replace('"timestamp"', '"time"', 1),
        lambda text: text[1:],
        lambda text: "[" + text,
    ],
)
def test_broken_documents_fail_whole(spark, folder, small_ranges, change):
    write(f"{folder}/in/good.json", json.dumps({"timeseries": points_of(20)}))
    write(f"{folder}/in/bad.json", change(json.dumps({"timeseries": points_of(60)})))
    with pytest.raises(FAILURES):
        points.parse_points(points.split_bodies(spark, f"{folder}/in")).collect()


def test_a_stale_registry_adds_no_series_twice(spark, folder):
    file = write(f"{folder}/a.csv", "Time,Production\n2019-01-01 00:00:00+00:00,1\n")
    more = write(f"{folder}/b.csv", "Time,Production,Other\n2019-01-02 00:00:00+00:00,2,3\n")
    carriers, path = seed_carriers(spark), f"{folder}/registry"
    empty = local_table(spark, [], META_SCHEMA)
    load = lambda f, meta, *entries: wide_csv.load_wide(
        spark, wide_csv.ImportSpec("Time", list(entries), [f]), meta, carriers, f"{folder}/ts", registry_path=path
    )
    load(file, empty, ENTRIES[0])
    load(more, empty, ENTRIES[0], entry("Other"))  # the registry before the first import
    stored = registry.read_registry(spark, path).orderBy("id").collect()
    assert [(r.id, r.identifier) for r in stored] == [(1, "production"), (2, "other")]
    found = {(r.meta_id, r.series_value) for r in samples.read_samples(spark, f"{folder}/ts").collect()}
    assert found == {(1, 1.0), (1, 2.0), (2, 3.0)}
    other = local_table(spark, [(2, "third", "kw", 6, False, "", True, 0)], META_SCHEMA)
    with pytest.raises(registry.RefusedSeries, match="id 2 of third"):
        load(more, other, ENTRIES[0])


# --- tables beside the samples ------------------------------------------------------------


def test_extents_are_kept_at_append(spark, folder):
    from wattframe.plans.series import series_extent

    path, kept = f"{folder}/ts", f"{folder}/extents"
    assert extents.read_extents(spark, kept).collect() == []
    samples.append_samples(batch(spark, (1, 5, 1), (2, 50_000, 1)), path, extents=kept)
    samples.append_samples(batch(spark, (1, 1, 1), (1, 90_000, 1), (3, 7, 1)), path, extents=kept)
    samples.append_samples(batch(spark, (1, 5, 9), (2, 49_000, 1)), path, "skip", extents=kept)
    with pytest.raises(samples.DuplicateSamples):
        samples.append_samples(batch(spark, (1, 5, 1), (9, 1, 1)), path, extents=kept)
    stored = samples.read_samples(spark, path)
    want = sorted(map(tuple, series_extent(stored).collect()))
    assert sorted(map(tuple, series_extent(stored, extents.read_extents(spark, kept)).collect())) == want
    extents.rebuild_extents(stored, f"{folder}/again")
    again = extents.read_extents(spark, f"{folder}/again")
    assert again.count() == 4 and sorted(map(tuple, series_extent(stored, again).collect())) == want


def test_pages_by_directory(spark, folder):
    from wattframe.plans.series import list_series

    rows = [(i, f"s{i}", "kw", None, None, None, None, 0) for i in [3, 4, 5, 17, 18, 40, 41, 42, 43, 90, 91]]
    meta = local_table(spark, rows, META_SCHEMA)
    none = spark.createDataFrame([], samples.STORED_SCHEMA)
    t = Tables(none, meta, seed_carriers(spark), None)
    directory = registry.page_directory(meta, width=10)
    assert sorted(map(tuple, directory.collect())) == [(3, 5, 3, 0), (17, 18, 2, 3), (40, 43, 4, 5), (90, 91, 2, 9)]
    with_pages = Tables(none, meta, t.carriers, None, pages=directory)
    for size in (1, 2, 3, 4, 20):
        for page in range(13):
            want = [r.id for r in list_series(t, page, size).collect()]
            assert [r.id for r in list_series(with_pages, page, size).collect()] == want
            narrow, skipped = registry.page_rows(meta, directory, page * size, size)
            assert narrow.count() - skipped >= len(want) and skipped <= 4


def test_records_within_a_range_are_not_shuffled(spark, folder, small_ranges):
    lines = [f'{i},"first ""{i}"",\nsecond",{i % 7}' for i in range(400)]
    Path(f"{folder}/in").mkdir()
    for name in "ab":
        Path(f"{folder}/in/{name}.csv").write_text("\n".join([f"head {name}", *lines]) + "\n")
    rows = records.records(spark, f"{folder}/in")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file#\d+, range#\d+", plan)
    found = rows.orderBy("file", "range", "place").collect()
    assert [r.record for r in found] == [x for name in "ab" for x in (f"head {name}", *lines)]
    assert [r.record for r in found if r.first] == ["head a", "head b"]
