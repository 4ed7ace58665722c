"""Wide meter exports: one time column, one column per series."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wattframe.functions.text import number_or_zero
from wattframe.sources.records import records
from wattframe.sources.registry import (
    append_rows,
    known_series,
    normalised,
    read_registry,
    registered_series,
    resolved,
    series_inputs,
)
from wattframe.sources.samples import append_samples, has_samples, read_samples
from wattframe.tables import local_table

# Fixed value: how the time column is written, with a numeric offset.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ssxxx"

ENTRY_SCHEMA = T.StructType(
    [T.StructField("column", T.StringType()), T.StructField("meta_id", T.IntegerType())]
)


@dataclass(frozen=True)
class ImportSpec:
    """Which files to import, their time column and the series among their columns.

    Files with ``line_breaks`` inside quoted fields are read twice, to find where records
    end; without, such a field fails the import.
    """

    time_column: str
    timeseries: list[dict]
    files: list[str] = field(default_factory=list)
    line_breaks: bool = False


def parse_spec(spec: dict | str) -> ImportSpec:
    """An import spec from a dict or JSON text."""
    content = json.loads(spec) if isinstance(spec, str) else spec
    return ImportSpec(
        content["time_column"],
        content["timeseries"],
        content.get("files") or [],
        bool(content.get("line_breaks")),
    )


def read_spec(path: str, spark: SparkSession | None = None) -> ImportSpec:
    """An import spec from a JSON or, where a YAML reader is installed, YAML file.

    With a session the file may lie wherever Spark can read, else where Python can.
    """
    if spark is None:
        text = Path(path).read_text()
    else:
        text = spark.read.text(path, wholetext=True).first().value
    if path.endswith(".json"):
        return parse_spec(text)
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("YAML specs need the yaml package; use JSON instead") from missing
    return parse_spec(yaml.safe_load(text))


def read_wide(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """All columns as text, with quotes doubled inside quoted fields.

    Files below one path must share their header: many equal files are best named by
    their folder, files with other headers by paths of their own. A file is read by many tasks,
    with ``line_breaks`` too.
    """
    files = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )
    if not line_breaks:
        return files.csv(path)
    columns = files.option("multiLine", True).csv(path).columns  # the first record alone
    names = [f"c{k}" for k in range(len(columns))]
    record = F.regexp_replace(F.regexp_replace("record", "\\r\\n", "\n"), "\\r$", "")
    rows = records(spark, path).withColumn("record", record).filter(F.trim("record") != "")
    schema = ", ".join(f"{name} string" for name in names)
    rows = rows.withColumn("fields", F.from_csv("record", schema, {"escape": '"', "mode": "FAILFAST"}))
    header = F.array(*(F.lit(c) for c in columns))
    other = F.raise_error(F.format_string("another header in %s", "file")).cast("boolean")
    differs = F.col("first") & (F.array(*(F.col("fields")[name] for name in names)) != header)
    return rows.filter(F.when(differs, other).otherwise(~F.col("first"))).select(
        *(F.col("fields")[name].alias(c) for name, c in zip(names, columns))
    )


def time_of(text: Column) -> Column:
    """Parse the time column; text of another form fails the job."""
    parsed = F.try_to_timestamp(text, F.lit(TIME_FORMAT))
    bad = F.raise_error(F.format_string("not a timestamp: %s", text))
    return F.when(parsed.isNull(), bad).otherwise(parsed)


def unpivot_wide(wide: DataFrame, time_column: str, columns: list[str]) -> DataFrame:
    """Long form (time, column, raw) of the listed columns the file has; case matters."""
    present = [c for c in columns if c in wide.columns]
    if not present:
        empty = wide.limit(0).select(F.col(f"`{time_column}`").alias("time"))
        text = F.lit(None).cast("string")
        return empty.withColumns({"column": text, "raw": text})
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in present]
    return wide.select(F.col(f"`{time_column}`").alias("time"), *texts).unpivot(
        "time", [F.col(f"`{c}`") for c in present], "column", "raw"
    )


def missing_columns(wide: DataFrame, spec: ImportSpec) -> list[str]:
    """Series of the spec the file has no column for; they are skipped."""
    return [e["identifier"] for e in spec.timeseries if e["identifier"] not in wide.columns]


@dataclass(frozen=True)
class WideImport:
    """Registry after the import, long samples of all files, skipped columns per file."""

    meta: DataFrame
    samples: DataFrame
    skipped: dict[str, list[str]]


def import_wide(
    spark: SparkSession, spec: ImportSpec, meta: DataFrame, carriers: DataFrame
) -> WideImport:
    """Plan the import of every file of the spec; nothing is written yet."""
    files = {path: read_wide(spark, path, spec.line_breaks) for path in spec.files}
    for path, wide in files.items():
        if spec.time_column not in wide.columns:
            raise ValueError(f"{path} has no column {spec.time_column!r}")
    skipped = {path: missing_columns(wide, spec) for path, wide in files.items()}
    used = [
        e
        for e in spec.timeseries
        if any(e["identifier"] in wide.columns for wide in files.values())
    ]
    inputs = series_inputs(spark, used)
    registry = registered_series(inputs, meta, carriers)
    keyed = normalised(inputs.withColumn("column", F.col("identifier")))
    # as many rows as the spec lists, so they fit where the spec does
    entries = resolved(keyed, registry).select("column", "meta_id").collect()
    unresolved = [row.column for row in entries if row.meta_id is None]
    if unresolved:
        raise ValueError(f"series without a registered carrier: {unresolved}")
    ids = local_table(spark, entries, ENTRY_SCHEMA)
    columns = sorted({e["identifier"] for e in used})
    cells = reduce(
        DataFrame.unionByName,
        (
            # parsed before the unpivot, once per line and not once per series
            unpivot_wide(
                wide.withColumn(spec.time_column, time_of(F.col(f"`{spec.time_column}`"))),
                spec.time_column,
                columns,
            )
            for wide in files.values()
        ),
    )
    samples = cells.join(F.broadcast(ids), "column").select(
        "meta_id",
        F.col("time").alias("series_timestamp"),
        number_or_zero(F.col("raw")).alias("series_value"),
    )
    return WideImport(registry, samples, skipped)


def load_wide(
    spark: SparkSession,
    spec: ImportSpec,
    meta: DataFrame,
    carriers: DataFrame,
    path: str,
    only_if_empty: bool = False,
    registry_path: str | None = None,
) -> WideImport | None:
    """Import and append to the sample table; None if ``only_if_empty`` and it is not.

    With a ``registry_path`` the series the import adds are appended there before any sample is
    stored, so no sample is left without its series. What is stored counts as known, whatever
    ``meta`` says: an import that is repeated with an old ``meta`` adds no series twice, and a
    row of ``meta`` whose id is stored for another series is refused.
    """
    if only_if_empty and has_samples(read_samples(spark, path)):
        return None
    if registry_path is not None:
        meta = known_series(meta, read_registry(spark, registry_path))
    planned = import_wide(spark, spec, meta, carriers)
    if registry_path is not None:
        known = meta.select("id")
        append_rows(planned.meta.join(known, "id", "left_anti"), registry_path)
        planned = replace(planned, meta=read_registry(spark, registry_path))
    append_samples(planned.samples, path)
    return planned
