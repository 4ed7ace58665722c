"""Seconds per headline query, as one JSON line.

The queries are the read mix of the published load test, further indicators, all weighed by
chunks of time as large tables are, the two ways of weighing alone, and a wide-to-long import
with its rows per second.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent / "tests")]

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.queries import ALL
from session import local_session
from wattframe.operators.series import MARKET_PRICE
from wattframe.operators.weights import sample_hours
from wattframe.plans import kpi, series
from wattframe.sources.event_log import event_tables
from wattframe.sources.wide_csv import TIME_FORMAT, ImportSpec, load_wide
from wattframe.tables import Tables

RUNS = 3
READINGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def drain(df: DataFrame) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def wide_export(spark: SparkSession, folder: str) -> str:
    """Line items as a meter export: a reading of four columns every 105 seconds."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").coalesce(1)
    seconds = F.unix_seconds(F.lit("2019-01-01 00:00:00").cast("timestamp")) + 105 * F.col("row")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/export"
    (
        lines.select(F.monotonically_increasing_id().alias("row"), *READINGS)
        .repartition(8)
        .select(
            F.date_format(F.timestamp_seconds(seconds), TIME_FORMAT).alias("Time"), *READINGS
        )
        .write.option("header", True)
        .csv(path)
    )
    return path


def import_export(spark: SparkSession, t: Tables, export: str) -> str:
    """Text to stored samples: parse, register, check for repeats, sort, write."""
    series_list = [
        {
            "identifier": name,
            "unit": "kW",
            "carrier": "electricity",
            "consumption": True,
            "description": name,
        }
        for name in READINGS
    ]
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/samples"
    load_wide(spark, ImportSpec("Time", series_list, [export]), t.meta, t.carriers, path)
    return path


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    t = event_tables(spark, folder)
    samples = t.ts.select("meta_id", "series_timestamp", "series_value")
    runs = {
        "co2_savings": lambda: kpi.co2_savings(t, "1hour", *ALL),
        "cost_savings": lambda: kpi.cost_savings(t, *ALL),
        "self_consumption": lambda: kpi.self_consumption(t, *ALL),
        "total_production": lambda: kpi.total_production(t, *ALL),
        "grid_consumption": lambda: kpi.grid_consumption(t, "1hour", *ALL),
        "local_production": lambda: kpi.local_production(t, "1hour", *ALL),
        "scope_one_emissions": lambda: kpi.scope_one_emissions(t, "1month", *ALL),
        "scope_two_emissions": lambda: kpi.scope_two_emissions(t, "1month", *ALL),
        "list_series": lambda: series.list_series(t),
        "series_scan": lambda: series.series_scan(t, MARKET_PRICE, *ALL).datapoints,
        "resample_mean": lambda: series.resample(t, MARKET_PRICE, "1hour", *ALL).datapoints,
        "total_consumption": lambda: kpi.total_consumption(t, *ALL),
        "autarky": lambda: kpi.autarky(t, *ALL),
        "consumption_by_carrier": lambda: kpi.consumption_by_carrier(t, "1hour", *ALL),
        "local_consumption": lambda: kpi.local_consumption(t, "1hour", *ALL),
        "total_co2_emissions": lambda: kpi.total_co2_emissions(t, "1hour", *ALL),
        "total_grid_electricity_cost": lambda: kpi.total_grid_electricity_cost(t, "1hour", *ALL),
        "weights_by_series": lambda: sample_hours(samples, "series"),
        "weights_chunked": lambda: sample_hours(samples, "chunked"),
    }
    seconds = {}
    for plan in runs.values():
        drain(plan())
    for name, plan in runs.items():
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            drain(plan())
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 4)

    export = wide_export(spark, folder)
    import_export(spark, t, export)
    start = time.perf_counter()
    path = import_export(spark, t, export)
    seconds["import_wide"] = round(time.perf_counter() - start, 4)
    rows = spark.read.parquet(path).count()

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "import_rows_per_second": round(rows / seconds["import_wide"]),
            }
        )
    )


if __name__ == "__main__":
    main()
