"""Streams against the batch result on the same files."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattframe.functions.intervals import with_bucket
from wattframe.sources.samples import read_samples
from wattframe.streaming.prices import (
    append_stream,
    stream_chunks,
    stream_price_samples,
    without_repeats,
)
from wattframe.operators.weights import sample_hours
from wattframe.streaming.log import ForeignLog, only_log
from wattframe.streaming.prices import arrivals, compact_arrivals, log_arrivals
from wattframe.streaming.resample import (
    compact_followed_means,
    compact_means,
    follow_means,
    followed_means,
    log_means,
    logged_means,
)
from wattframe.streaming.weights import weigh_stream, weighed_stream

START = int(datetime(2019, 6, 3).timestamp() * 1000)


def land(folder, name, first_hour, hours, price=1.0):
    """A chunk file of hourly prices; every tenth has none."""
    series = [[START + h * 3600000, None if h % 10 == 9 else price * h] for h in range(first_hour, first_hour + hours)]
    path = Path(folder, "landing", name)
    path.parent.mkdir(exist_ok=True)
    path.write_text(json.dumps({"series": series}))


def chunk(name):
    """A file name of the price series; the start differs by name and lies within the bounds."""
    return f"4169_DE_hour_{START + sum(map(ord, name))}.json"


def expected(*hours):
    return {datetime.fromtimestamp(START / 1000 + h * 3600): float(h) for h in hours if h % 10 != 9}


def stored(spark, folder):
    rows = read_samples(spark, f"{folder}/ts").collect()
    assert len({(r.meta_id, r.series_timestamp) for r in rows}) == len(rows)
    return {r.series_timestamp: r.series_value for r in rows}


def run(spark, folder, per_batch=1):
    stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing", per_batch), 21)
    append_stream(stream, f"{folder}/ts", f"{folder}/state").awaitTermination()


def test_repeated_polls_store_each_price_once(spark, folder):
    land(folder, chunk("a"), 0, 100)
    land(folder, chunk("b"), 50, 100)
    run(spark, folder)
    assert stored(spark, folder) == expected(*range(150))
    # a grown chunk and a file far older than everything before
    land(folder, chunk("c"), 140, 40)
    land(folder, chunk("d"), -5000, 20)
    run(spark, folder)
    assert stored(spark, folder) == expected(*range(180), *range(-5000, -4980))
    run(spark, folder)
    assert len(stored(spark, folder)) == len(expected(*range(180), *range(-5000, -4980)))


def test_a_replayed_batch_adds_nothing(spark, folder):
    land(folder, chunk("a"), 0, 30)
    run(spark, folder)
    stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing"), 21)
    append_stream(stream, f"{folder}/ts", f"{folder}/other-state").awaitTermination()
    assert stored(spark, folder) == expected(*range(30))


def test_repeats_by_state(spark, folder):
    for name in "ab":
        land(folder, chunk(name), 0, 30)
    stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing", 1), 21)
    written = (
        without_repeats(stream).writeStream.option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    )
    written.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == len(expected(*range(30)))


@pytest.mark.parametrize("interval", ["90min", "1day", "1week", "1month"])
def test_means_agree_with_the_batch(spark, folder, interval):
    """However late a file comes."""
    def log():
        chunks = stream_chunks(spark, f"{folder}/landing", 1)
        log_means(
            stream_price_samples(chunks, 21), interval, f"{folder}/log", f"{folder}/means-state"
        ).awaitTermination()

    land(folder, chunk("new"), 2000, 50)
    log()
    for i in range(3):
        land(folder, chunk(str(i)), i * 50, 50)
    log()
    run(spark, folder)
    batch = with_bucket(read_samples(spark, f"{folder}/ts"), interval).groupBy("bucket").agg(F.avg("series_value"))
    found = {r.bucket: r.mean_value for r in logged_means(spark, f"{folder}/log").collect()}
    assert found == pytest.approx({r[0]: r[1] for r in batch.collect()})


def test_followed_means_agree_with_the_batch(spark, folder):
    """Open days and late files included."""
    for i in (3, 0, 2, 1):
        land(folder, chunk(str(i)), i * 50, 50)
    stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing", 1), 21)
    follow_means(stream, "1day", f"{folder}/log", f"{folder}/follow-state").awaitTermination()
    run(spark, folder)
    batch = with_bucket(read_samples(spark, f"{folder}/ts"), "1day").groupBy("bucket").agg(F.avg("series_value"))
    found = {r.bucket: r.mean_value for r in followed_means(spark, f"{folder}/log").collect()}
    assert found == pytest.approx({r[0]: r[1] for r in batch.collect()})
    assert len(only_log(spark, f"{folder}/log").batches()) >= 4


def test_a_log_takes_one_query(spark, folder):
    """A second checkpoint would number its batches from zero again."""
    def log(state):
        stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing"), 21)
        log_means(stream, "1day", f"{folder}/log", f"{folder}/{state}").awaitTermination()

    land(folder, chunk("a"), 0, 30)
    log("one")
    before = logged_means(spark, f"{folder}/log").collect()
    with pytest.raises(Exception, match="belongs to query"):
        log("two")
    assert sorted(logged_means(spark, f"{folder}/log").collect()) == sorted(before)
    assert issubclass(ForeignLog, ValueError)


def test_other_series_bounds_and_index_count(spark, folder):
    land(folder, chunk("a"), 0, 10)
    land(folder, "1_DE_hour_1559520000000.json", 500, 10, 99.0)
    land(folder, "4169_DE_hour_1684792800000.json", 700, 10)  # a start in 2023
    land(folder, "notes.json", 900, 10)
    land(folder, chunk("zz"), 50, 10)
    run(spark, folder)
    assert stored(spark, folder) == expected(*range(10), *range(50, 60))
    index = spark.createDataFrame([(START + ord("a"),)], "chunk long")
    chunks = stream_chunks(spark, f"{folder}/landing")
    stream = stream_price_samples(chunks, 21, index=index)
    append_stream(stream, f"{folder}/indexed", f"{folder}/indexed-state").awaitTermination()
    assert read_samples(spark, f"{folder}/indexed").count() == len(expected(*range(10)))


def test_calendar_windows_do_not_stream(spark, folder):
    land(folder, chunk("a"), 0, 3)
    samples = stream_price_samples(stream_chunks(spark, f"{folder}/landing"), 21)
    with pytest.raises(ValueError):
        follow_means(samples, "1month", f"{folder}/log", f"{folder}/state")


def test_followed_means_refuse_a_second_checkpoint(spark, folder):
    """It would number its batches from zero again and hide or mix older means."""
    def follow(state):
        stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing", 1), 21)
        follow_means(stream, "1day", f"{folder}/log", f"{folder}/{state}").awaitTermination()

    land(folder, chunk("a"), 0, 60)
    follow("one")
    before = sorted(followed_means(spark, f"{folder}/log").collect())
    land(folder, chunk("b"), 60, 60)
    with pytest.raises(Exception, match="belongs to query"):
        follow("two")
    assert sorted(followed_means(spark, f"{folder}/log").collect()) == before
    follow("one")
    assert len(followed_means(spark, f"{folder}/log").collect()) > len(before)


def folders(spark, path):
    log = only_log(spark, path)
    return len(log.batches()), len(log.generations())


@pytest.mark.parametrize("kind", ["sums", "latest"])
def test_compacted_logs_say_the_same(spark, folder, kind):
    """Before, after and during a compaction, with batches that come in between."""
    write, read, compact = {
        "sums": (log_means, logged_means, compact_means),
        "latest": (follow_means, followed_means, compact_followed_means),
    }[kind]
    log = f"{folder}/log"

    def go(*names):
        for name in names:
            land(folder, chunk(name), ord(name) * 7 % 90, 40)
        stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing", 1), 21)
        write(stream, "1day", log, f"{folder}/state").awaitTermination()

    value = lambda df: {(r.meta_id, r.bucket): pytest.approx(r.mean_value) for r in df.collect()}
    go("a", "b", "c", "d")
    whole = value(read(spark, log))
    held = read(spark, log)  # planned before, read after the next two compactions' first removal
    compact(spark, log)
    assert value(read(spark, log)) == whole and value(held) == whole
    compact(spark, log)  # nothing new to merge
    assert folders(spark, log)[1] == 1 and value(read(spark, log)) == whole
    for names in ("ef", "gh", "ij"):
        go(*names)
        whole = value(read(spark, log))
        compact(spark, log)
        assert value(read(spark, log)) == whole
        batches, generations = folders(spark, log)
        assert batches <= 8 and generations <= 2
    # an unfinished generation counts for nothing
    query = only_log(spark, log)
    Path(query.generation(query.batches()[-1] + 5)).mkdir()
    assert value(read(spark, log)) == whole


def test_arrivals_are_logged_once_without_state(spark, folder):
    def go(*files):
        for name, first, hours, price in files:
            land(folder, chunk(name), first, hours, price)
        stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing", 1), 21)
        log_arrivals(stream, f"{folder}/log", f"{folder}/state").awaitTermination()

    go(("a", 0, 50, 1.0), ("b", 30, 50, 1.0))
    go(("c", 0, 100, 1.0), ("d", -3000, 10, 1.0))
    compact_arrivals(spark, f"{folder}/log")
    go(("e", -3000, 20, 5.0), ("f", 90, 30, 1.0))
    compact_arrivals(spark, f"{folder}/log")
    rows = arrivals(spark, f"{folder}/log").collect()
    found = {r.series_timestamp: r.series_value for r in rows}
    want = expected(*range(120), *range(-3000, -2990))
    late = {k: 5.0 * v for k, v in expected(*range(-2990, -2980)).items()}
    assert len(rows) == len(found) and found == want | late
    assert not list(Path(folder, "state").glob("state/**/*.delta"))
    with pytest.raises(Exception, match="belongs to query"):
        stream = stream_price_samples(stream_chunks(spark, f"{folder}/landing"), 21)
        log_arrivals(stream, f"{folder}/log", f"{folder}/other").awaitTermination()


# --- continuous weights ----------------------------------------------------------------

SAMPLE = "meta_id int, series_timestamp timestamp, series_value double, beat boolean"


def feed(spark, folder, *batches, delay="2hour", state="state"):
    """Rows (series, minute, value or None for a beat), a file for each batch."""
    for rows in batches:
        number = len(list(Path(folder).glob("in/part*")))
        data = [(s, datetime.fromtimestamp(START / 1000 + m * 60), float(m % 7), v is None) for s, m, v in rows]
        spark.createDataFrame(data, SAMPLE).coalesce(1).write.parquet(f"{folder}/one-{number}")
        (made,) = Path(folder, f"one-{number}").glob("*.parquet")
        Path(folder, "in").mkdir(exist_ok=True)
        Path(folder, "in", f"part-{number:04}.parquet").write_bytes(made.read_bytes())
        stream = spark.readStream.schema(SAMPLE).parquet(f"{folder}/in")
        weigh_stream(stream, f"{folder}/log", f"{folder}/{state}", delay).awaitTermination()


def plain_hours(spark, rows):
    data = [(s, datetime.fromtimestamp(START / 1000 + m * 60), float(m % 7)) for s, m, v in rows if v is not None]
    df = spark.createDataFrame(data, "meta_id int, series_timestamp timestamp, series_value double")
    return {(r.meta_id, r.series_timestamp): round(r.hours, 9) for r in sample_hours(df, "series").collect()}


def test_continuous_weights_equal_those_of_the_batch(spark, folder):
    """Four batches out of order; what is logged is final from the start."""
    import random

    rng = random.Random(4)
    rows = [(s, round(m, 2), 1) for s in (1, 2) for m in sorted({rng.randrange(0, 90000) / 100 for _ in range(150)})]
    rows += [(3, 10.0, 1), (4, 3.0, 1), (4, 13.0, 1), (4, 700.0, 1)]
    key = {r: r[1] + rng.uniform(-55, 55) for r in rows}  # an hour's disorder at most on each side
    rows.sort(key=key.get)
    parts = [rows[len(rows) * i // 4 : len(rows) * (i + 1) // 4] for i in range(4)]
    want, seen = plain_hours(spark, rows), {}
    for part in [*parts, [(s, 3000.0, None) for s in (1, 2, 3, 4)]]:
        feed(spark, folder, part)
        now = {(r.meta_id, r.series_timestamp): round(r.hours, 9) for r in weighed_stream(spark, f"{folder}/log").collect()}
        assert seen.items() <= now.items() <= want.items()
        seen = now
    assert seen == want
    assert len(only_log(spark, f"{folder}/log/state").batches()) <= 2


def test_late_samples_are_told_and_not_dropped(spark, folder):
    rows = [(1, 0.0, 1), (1, 5.0, 1), (1, 600.0, 1)]
    feed(spark, folder, rows, [(1, 3.0, 1), (1, 590.0, 1)], [(1, 1000.0, None)])
    got = weighed_stream(spark, f"{folder}/log").orderBy("series_timestamp").collect()
    assert [(r.late, None if r.hours is None else round(r.hours, 6)) for r in got] == [
        (False, 0.083333), (True, None), (False, 0.083333), (False, 0.25), (False, 0.166667)
    ]
    with pytest.raises(Exception, match="belongs to query"):
        feed(spark, folder, [(1, 1010.0, 1)], state="other")


def test_a_first_sample_waits_for_its_successor(spark, folder):
    feed(spark, folder, [(1, 0.0, 1), (1, 130.0, None)], delay="2hour")
    assert weighed_stream(spark, f"{folder}/log").count() == 0  # 10 minutes are certain, 15 are needed
    feed(spark, folder, [(1, 12.0, 1)], [(1, 133.0, None)], delay="2hour")
    got = weighed_stream(spark, f"{folder}/log").orderBy("series_timestamp").collect()
    assert [round(r.hours, 6) for r in got] == [0.2, 0.2]
