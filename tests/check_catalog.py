"""Compare every query with its SQL: python tests/check_catalog.py [folder] [name ..]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values in comparable types, rows sorted."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame:
        column = frame[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            frame[name] = column.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(column):
            frame[name] = column.astype(object).map(lambda v: "None" if pd.isna(v) else str(v))
        elif pd.api.types.is_numeric_dtype(column):
            frame[name] = column.astype(float)
        else:
            frame[name] = column.map(lambda v: "None" if pd.isna(v) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark, connection, folder: str, name: str) -> str:
    """Empty if the query and its SQL agree, else what differs."""
    got = normal(spark_entry.queries()[name](spark, folder).toPandas())
    want = normal(connection.sql(spark_entry.oracle_sql()[name]).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} instead of {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    if not got.equals(want):
        bad = (got != want) & ~(got.isna() & want.isna())
        rows = bad.any(axis=1)
        if rows.any():
            return f"{rows.sum()} rows differ, first:\n{got[rows].head(3)}\n{want[rows].head(3)}"
    return ""


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


if __name__ == "__main__":
    from session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(spark_entry.queries())
    session, db, failed = local_session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = differences(session, db, folder, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.2f}s {problem}", flush=True)
    missing = set(spark_entry.queries()) ^ set(spark_entry.oracle_sql())
    print(f"{len(names)} queries, {failed} differ; without counterpart: {sorted(missing)}")
