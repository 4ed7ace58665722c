"""Records of large text files whose separators may also stand inside quotes.

Spark reads ranges of a file in many tasks, but a range doesn't know whether it begins inside
quotes. So quotes are counted per range first; their running sum tells how each range begins,
and with it which separators end a record. A task puts together the records that lie within its
range as it reads them; only the pieces of those that run over ranges are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RANGE = ["file", "range"]

# Tasks get the code of this module with the function they run, so no worker needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def quote_count(text: Column) -> Column:
    """Quotes of a text; one that is doubled inside quotes leaves the parity as it is."""
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def unescaped_quote_count(text: Column) -> Column:
    """Quotes of a text without those behind a backslash."""
    return quote_count(F.regexp_replace(text, r"\\.", ""))


def _pieces(spark: SparkSession, path: str, separator: str, quotes: Callable[[Column], Column]) -> DataFrame:
    """What lies between separators, in the order of the file within a task, with its quotes."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        (quotes(F.col("value")) % 2).cast("int").alias("odd"),
        "value",
        F.col("_metadata.file_size").alias("size"),
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch, np.ndarray]]:
    """Stretches of one range each: its key, whether it begins there, its rows, and the quotes
    before each of them, modulo 2. A range is in one task, its pieces one after the other."""
    last, parity = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, at = batch.column(0), batch.column(1).to_numpy()
        ends = pc.run_end_encode(file).run_ends.to_numpy()
        cuts = np.unique(np.concatenate([ends[:-1], np.flatnonzero(at[1:] != at[:-1]) + 1, [0, batch.num_rows]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (file[int(a)].as_py(), int(at[a]))
            begins = key != last
            if begins:
                last, parity = key, 0
            part = batch.slice(int(a), int(b - a))
            sums = (parity + np.cumsum(part.column(2).to_numpy())) & 1
            yield key, begins, part, np.append(parity, sums[:-1])
            parity = int(sums[-1])


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its quotes and the numbers of its last pieces with none and with one before."""

    def rows(state):
        (file, at), odd, even_piece, odd_piece = state
        columns = [[file], [at], [odd], [even_piece], [odd_piece]]
        kinds = [pa.string(), *[pa.int64()] * 4]
        names = [*RANGE, "odd", "last_even", "last_odd"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    state, number = None, 0
    for key, begins, part, inside in _by_range(batches):
        if begins:
            if state:
                yield rows(state)
            state, number = [key, 0, None, None], 0
        for parity in (0, 1):
            found = np.flatnonzero(inside == parity)
            if found.size:
                state[2 + parity] = number + int(found[-1])
        state[1] = int(inside[-1] + part.column(2)[-1].as_py()) & 1
        number += part.num_rows
    if state:
        yield rows(state)


def _ranges(pieces: DataFrame) -> DataFrame:
    """One row per range: whether it begins inside quotes, and the last record begun before it."""
    sums = pieces.select(*RANGE, "odd").mapInArrow(
        _range_rows, "file string, range long, odd long, last_even long, last_odd long"
    )
    file = Window.partitionBy("file").orderBy("range")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    sums = sums.withColumns({"opened": opened, "open_end": F.sum("odd").over(Window.partitionBy("file")) % 2})
    last = F.when(F.col("opened") == 0, F.col("last_even")).otherwise(F.col("last_odd"))
    sums = sums.withColumn("begun", F.when(last.isNotNull(), F.struct("range", last.alias("place"))))
    return sums.select(*RANGE, "opened", "open_end", F.last("begun", ignorenulls=True).over(before).alias("carried"))


RECORD = "file string, size long, range long, place long, first boolean, record string, begun_range long, begun_place long"


def _record_rows(separator: str):
    """Whole records of each range, and what lies at its ends, which have the piece they began with."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, place, texts, begun, number = None, 0, 0, [], None, 0

        def end():  # of a range: the record may go on in the next
            text = separator.join(texts)
            return (key[0], size, key[1], place, key[1] == 0 and place == 0, text, *begun)

        for now, begins, part, inside in _by_range(batches):
            values = part.column(3).to_pylist()
            out = []
            if begins:
                if texts:
                    out.append(end())
                carried = part.column(6)[0].as_py() or {"range": None, "place": None}
                key, size, place, texts, number = now, part.column(4)[0].as_py(), 0, [], 0
                begun = (carried["range"], carried["place"])
            starts = inside == part.column(5)[0].as_py()
            for value, new in zip(values, starts.tolist(), strict=True):
                if new:
                    if texts:
                        whole = begun == (key[1], place)
                        out.append(end()[:6] + ((None, None) if whole else begun))
                    place, texts, begun = number, [], (key[1], number)
                texts.append(value)
                number += 1
            if out:
                yield batch_of(out)
        if texts:
            yield batch_of([end()])

    return run


def records(
    spark: SparkSession, path: str, separator: str = "\n", quotes: Callable[[Column], Column] = quote_count
) -> DataFrame:
    """(file, size, range, place, first, record) of the files at a path, in no order.

    ``range`` and ``place`` order the records of a file, ``first`` tells the first one. A
    separator between quotes is part of its record. Files are read twice, in ranges; one record
    must fit a task, and quotes that are never closed fail the job.
    """
    # A row per range, that is per spark.sql.files.maxPartitionBytes of a file.
    ranges = F.broadcast(_ranges(_pieces(spark, path, separator, quotes)))
    rows = _pieces(spark, path, separator, quotes).join(ranges, RANGE)
    unclosed = F.raise_error(F.format_string("quotes are not closed in %s", "file"))
    value = F.when(F.col("open_end") == 0, F.col("value")).otherwise(unclosed).alias("value")
    rows = rows.select(*RANGE, "odd", value, "size", F.col("opened").cast("int").alias("opened"), "carried")
    read = rows.mapInArrow(_record_rows(separator), RECORD)
    columns = ["file", "size", "range", "place", "first", "record"]
    parts = read.filter(F.col("begun_place").isNotNull()).groupBy("file", "size", "begun_range", "begun_place").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("range", "place", "record"))).alias("parts")
    )
    joined = parts.select(
        "file",
        "size",
        F.col("begun_range").alias("range"),
        F.col("begun_place").alias("place"),
        "first",
        F.array_join("parts.record", separator).alias("record"),
    )
    return read.filter(F.col("begun_place").isNull()).select(*columns).unionByName(joined)
