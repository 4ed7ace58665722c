"""Substring dedup: repeated paragraphs found by MinHash banding and removed but for one.

Paragraphs are whole lines, blocks of lines between blank lines, and passages inside them. For
the last, lines are cut further where the words themselves say so, which gives small pieces that
are the same wherever a passage is copied to; pairs of neighbouring pieces that occur in several
places form passages, cut wherever the number of occurrences or the documents change. Bands of
the paragraphs' circulant MinHash propose links, exact Jaccard on 5-word shingles confirms them,
and components tell what to remove.

Lines and blocks that can't have a partner leave before that: of two sets with a Jaccard of the
threshold, the least shingles by hash, as many as may be missing in the other and one more, share
one at least. This prefix is exact, so it leaves out no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattframe.llm.minhash import band_keys, fingerprints, grouped, signatures
from wattframe.llm.staging import drop, stage
from wattframe.llm.words import (
    _BASE, _GRAM, _INVERSE, Words, _power_table, mix, sets_of, signed, slices, text_bytes, words_of,
)

SHINGLE = 5
PERCENT = 80
MIN_WORDS = 20
REACH = 3  # words on either side that a cut depends on
SPANS = "array<struct<first:long,last:long>>"
KEY = ["doc_id", "text_digest"]  # different texts may share an id
LINES = 1 << 16  # lines taken at once
TOKEN = np.uint64(48)  # bits of a shingle's hash in a prefix


def tuned_bands(percent: int, miss: float = 1e-5, largest: int = 160) -> tuple[int, int]:
    """Bands and rows with the most rows a band that still miss a pair at the threshold
    with a chance of at most ``miss``, using ``largest`` coordinates or fewer."""
    for rows in range(largest, 1, -1):
        for bands in range(1, largest // rows + 1):
            if (1 - (percent / 100) ** rows) ** bands <= miss:
                return bands, rows
    return largest, 1


def pieces(words: Words) -> np.ndarray:
    """First words of all pieces of all texts.

    A piece starts with each text, each line, and each word whose hash with the word before it
    is the least of those ``REACH`` words around.
    """
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.int64)
    least = np.full(n + 2 * REACH, np.uint64(0xFFFFFFFFFFFFFFFF))
    least[REACH + 1 : REACH + n] = mix(words.hashes[1:] * _GRAM[1] + words.hashes[:-1])
    own = least[REACH : REACH + n]
    cut = np.ones(n, bool)
    for k in range(1, REACH + 1):
        cut &= own < least[REACH - k : REACH - k + n]
        cut &= own <= least[REACH + k : REACH + k + n]
    breaks = np.flatnonzero(words.data == 10)
    after = np.searchsorted(words.starts, breaks)
    cut[after[after < n]] = True
    heads = words.bounds[:-1][np.diff(words.bounds) > 0]
    cut[heads] = True
    return np.flatnonzero(cut)


def stretches(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the lines, and of the blocks of several lines between blank
    lines, that have ``min_words`` words; a text without a blank line is no block."""
    n = len(words.hashes)
    gaps = np.bincount(np.searchsorted(words.starts, np.flatnonzero(words.data == 10)), minlength=n + 1)[:n]
    # Of a text's first word, the gap may belong to the text before.
    heads = np.zeros(n, bool)
    heads[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    lines, blocks = np.flatnonzero(heads | (gaps > 0)), np.flatnonzero(heads | (gaps > 1))
    line_ends, block_ends = np.append(lines[1:], n)[: len(lines)], np.append(blocks[1:], n)[: len(blocks)]
    several = np.searchsorted(lines, block_ends) - np.searchsorted(lines, blocks) > 1
    text, end_text = (np.searchsorted(words.bounds, x, "right") - 1 for x in (blocks, block_ends - 1))
    whole = (blocks == words.bounds[text]) & (block_ends == words.bounds[end_text + 1])
    blocks, block_ends = blocks[several & ~whole], block_ends[several & ~whole]
    first, last = np.concatenate([lines, blocks]), np.concatenate([line_ends, block_ends])
    long = last - first >= min_words
    return first[long], last[long]


def prefixes(words: Words, first: np.ndarray, last: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the stretches' least shingles, and which stretch each belongs to.

    A set of m that has a Jaccard of ``percent`` with another shares ``ceil(m * percent / 100)``
    shingles or more with it, so one at least is among the least of both.
    """
    keys, owners = [], []
    n = len(words.hashes)
    sums = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        sums += words.hashes[k : n - SHINGLE + 1 + k] * _GRAM[k]
    sums = mix(sums) >> (np.uint64(64) - TOKEN)
    for at in range(0, len(first), LINES):
        begin, size = first[at : at + LINES], (last - first)[at : at + LINES] - SHINGLE + 1
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        sets = np.repeat(np.arange(len(size), dtype=np.uint64) << TOKEN, size) | sums[places]
        sets.sort()
        sets = sets[np.append(True, sets[1:] != sets[:-1])]
        owner = (sets >> TOKEN).astype(np.int64)
        counts = np.bincount(owner, minlength=len(size))
        number = np.arange(len(sets)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = number <= (counts - (counts * percent + 99) // 100)[owner]
        keys.append(mix((sets[own] & ((np.uint64(1) << TOKEN) - np.uint64(1))) + (np.uint64(1) << TOKEN)))
        owners.append(owner[own] + at)
    return np.concatenate(keys or [sums[:0]]), np.concatenate(owners or [np.zeros(0, np.int64)])


def _unit_rows(min_words: int, percent: int):
    """Hash, document and place (first word and number of words) of each two neighbouring
    pieces, and of each piece that is long enough alone.

    Lines and blocks give a row for each shingle of their prefix; their places are below zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column(1))
            n = len(words.hashes)
            cuts = pieces(words)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(words.hashes * _power_table(_BASE, n)[:n], out=sums[1:])
            ends = np.append(cuts[1:], n)
            text = np.searchsorted(words.bounds, cuts, "right") - 1
            alone = np.flatnonzero(ends - cuts >= min_words)
            both = np.flatnonzero(text[1:] == text[:-1])
            first = np.concatenate([cuts[both], cuts[alone]])
            last = np.concatenate([ends[both + 1], ends[alone]])
            text = np.concatenate([text[both], text[alone]])
            size = last - first
            hashes = mix((sums[last] - sums[first]) * _power_table(_INVERSE, n + 1)[first] + size.astype(np.uint64))
            place = (first - words.bounds[text] << 32) + size
            begin, end = stretches(words, max(min_words, SHINGLE))
            keys, owner = prefixes(words, begin, end, percent)
            owner_text = np.searchsorted(words.bounds, begin, "right") - 1
            line = ~((begin - words.bounds[owner_text] << 32) + end - begin)
            text = pa.array(np.concatenate([text, owner_text[owner]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([hashes, keys]))),
                    part.column(0).take(text),
                    part.column(2).take(text),
                    pa.array(np.concatenate([place, line[owner]])),
                ],
                ["unit", *KEY, "place"],
            )

    return run


def runs(
    first: np.ndarray, last: np.ndarray, count: np.ndarray, mark: np.ndarray, min_words: int, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Stretches of overlapping units, in order of their first words, that repeat as one.

    These are, for every number of occurrences, the longest stretches of units with so many
    or more, and the longest stretches of units in the same documents (of one count and mark).
    A stretch is left out where it makes up so much of another that all who hold it are linked
    by that other one already: with a share t of either text, two of them have a Jaccard of
    t / (2 - t).
    """
    found: set[tuple[int, int]] = set()
    chained = np.append(first[1:] < np.maximum.accumulate(last)[:-1], False).tolist()
    starts, ends, counts, marks = first.tolist(), last.tolist(), count.tolist(), mark.tolist()
    open_: list[tuple[int, int]] = []  # first word and count, counts rising
    reach = 0
    same = None
    for i, n in enumerate(counts):
        at = starts[i]
        while open_ and open_[-1][1] > n:
            at, _ = open_.pop()
            found.add((at, reach))
        if not open_ or open_[-1][1] < n:
            open_.append((at, n))
        if same is not None and same[1:] != (n, marks[i]):
            found.add((same[0], reach))
            same = None
        if same is None:
            same = (starts[i], n, marks[i])
        reach = max(reach, ends[i])
        if not chained[i]:
            found.update((at, reach) for at, _ in open_)
            found.add((same[0], reach))
            open_, reach, same = [], 0, None
    out: list[tuple[int, int]] = []
    around: list[tuple[int, int]] = []
    for a, b in sorted((x for x in found if x[1] - x[0] >= min_words), key=lambda x: (x[0], -x[1])):
        while around and around[-1][1] < b:
            around.pop()
        if around:
            own, wide = b - a - SHINGLE + 1, around[-1][1] - around[-1][0] - SHINGLE + 1
            if own * (100 + percent) >= 2 * percent * wide:
                continue
        around.append((a, b))
        out.append((a, b))
    return out


def _unit_counts(min_words: int, percent: int):
    """How often each unit is in a slice of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unit_rows(min_words, percent)(batches):
            units, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(counts)], ["unit", "n"])

    return run


def _run_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            own = batch.column(2)
            bounds = own.offsets.to_numpy()
            place, count, mark = (x.to_numpy() for x in own.values.flatten())
            found = {"spans": [], "lines": []}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                order = a + np.argsort(place[a:b], kind="stable")
                units, lines = order[place[order] >= 0], ~place[order[place[order] < 0]]
                first, size = place[units] >> 32, place[units] & 0xFFFFFFFF
                # all of them: which may be left out, their shingles tell
                part = runs(first, first + size, count[units], mark[units], min_words, 100)
                found["spans"].append([{"first": x, "last": y} for x, y in part])
                found["lines"].append([{"first": int(x >> 32), "last": int((x >> 32) + (x & 0xFFFFFFFF))} for x in lines])
            columns = [pa.array(x, kind) for x in found.values()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [*KEY, *found])
            yield out.filter(pa.array([bool(x or y) for x, y in zip(*found.values(), strict=True)], pa.bool_()))

    return run


def candidates(
    spans: list[tuple[int, int]], lines: list[tuple[int, int]], shingles: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """The lines, and the runs but for those left out as ``runs`` says, by their sets.

    ``runs`` goes by length, which is right where no shingle of a text repeats. Elsewhere a
    run stays unless its set makes up as much of the other's.
    """
    before = None
    out: list[tuple[int, int]] = []
    around: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        while around and around[-1][1] < b:
            around.pop()
        if around:
            first, last = around[-1]
            own, wide = b - a - SHINGLE + 1, last - first - SHINGLE + 1
            if own * (100 + percent) >= 2 * percent * wide:
                if before is None:  # where the same shingle was last
                    order = np.argsort(shingles, kind="stable")
                    same = shingles[order[1:]] == shingles[order[:-1]]
                    before = np.full(len(shingles), -1)
                    before[order[1:][same]] = order[:-1][same]
                own = np.count_nonzero(before[a : b - SHINGLE + 1] < a)
                wide = np.count_nonzero(before[first : last - SHINGLE + 1] < first)
                if own * (100 + percent) >= 2 * percent * wide:
                    continue
        around.append((a, b))
        out.append((a, b))
    return sorted({*out, *lines})


def _pairs(column: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Rows of a column of ``SPANS``."""
    first, last = (x.to_numpy().tolist() for x in column.flatten().flatten())
    found = list(zip(first, last, strict=True))
    ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
    return [found[a:b] for a, b in zip([0, *ends], ends)]


def _paragraph_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column(2))
            n = len(words.hashes)
            sums = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
            for k in range(SHINGLE):
                sums += words.hashes[k : n - SHINGLE + 1 + k] * _GRAM[k]
            sums = mix(sums)
            found: list[tuple[int, int]] = []
            counts = []
            for base, top, spans, lines in zip(
                words.bounds[:-1].tolist(), words.bounds[1:].tolist(), *(_pairs(part.column(x)) for x in (3, 4)), strict=True
            ):
                own = candidates(spans, lines, sums[base : max(top - SHINGLE + 1, base)], percent)
                found += own
                counts.append(len(own))
            if not found:
                continue
            text = np.repeat(np.arange(len(counts)), counts)
            first, last = np.array(found, np.int64).T
            begin, end = words.bounds[text] + first, words.bounds[text] + last
            size = end - begin - SHINGLE + 1
            ends = np.cumsum(size)
            sets, bounds = sets_of(
                sums[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)], np.concatenate(([0], ends))
            )
            hi, lo = fingerprints(sets, bounds)
            byte = words.offsets[text]
            places = [first, last, words.starts[begin] - byte, words.ends[end - 1] - byte]
            keys = [part.column(x).take(pa.array(text)) for x in (0, 1)]
            buffers = [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(sets)]
            yield pa.RecordBatch.from_arrays(
                [*keys, *map(pa.array, places), pa.array(hi), pa.array(lo), pa.Array.from_buffers(pa.binary(), len(text), buffers)],
                [*KEY, "first", "last", "start", "end", "hi", "lo", "shingles"],
            )

    return run


def _band_rows(bands: int, rows: int):
    """Sizes and bands of the sets of the rows (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                keys = signed(band_keys(signatures(np.concatenate(sets), bounds, bands * rows), bands, rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], ["node", "size", "bands"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per paragraph that repeats, in other texts or in its own, none for other text.

    Paragraphs are all lines, all blocks of lines between blank lines, and all passages of
    exactly repeated pieces, within lines or across them.

    Columns: doc_id, start and end (bytes of the text), first_word and n_words, passage_doc and
    passage_start (the place that is kept of its component: the smallest doc_id, then start)
    and removed (false at that place). Overlapping paragraphs of one document and component are
    one place, so what is kept never loses a part to its own component. Paragraphs are linked when their sets of five successive
    words, A-Z lower-cased, overlap by ``percent`` of the union or more; shorter ones than
    ``min_words`` words don't count, so common short lines stay.

    Pairs of pieces are counted before they meet their documents, so a passage that a third of all
    documents share is a join with a split hot key. NULL and empty texts have no paragraphs;
    repeated rows repeat their paragraphs; different texts of one id, which ``text_digest``
    (xxhash64) tells apart, are places of their own; rows without an id are left out; other
    columns are ignored; an empty table gives no rows.
    """
    texts = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .where("doc_id is not null and text is not null")
        .select("doc_id", "text", F.xxhash64("text").alias("text_digest"))
    )
    rows = texts.mapInArrow(_unit_rows(min_words, percent), "unit long, doc_id long, text_digest long, place long")
    counts = texts.mapInArrow(_unit_counts(min_words, percent), "unit long, n long")
    shared = stage(counts.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1").select("unit"), "units")
    # by shuffle at every size, here and below: units and runs grow with the texts; the larger side isn't sorted
    met = stage(rows.join(shared.hint("shuffle_hash"), "unit"), "met")
    place = F.struct(*KEY, "place")
    holder = F.xxhash64(*KEY)
    counted = stage(
        met.where("place >= 0")
        .groupBy("unit")
        .agg(
            F.min(place).alias("low"),
            F.max(place).alias("high"),
            F.count("*").alias("n"),
            # the sum tells holders apart that come in pairs and leave no bits
            F.bit_xor(holder).bitwiseXOR(F.sum(holder % (1 << 31))).alias("mark"),
        )
        .where("low < high")
        .select("unit", "n", "mark"),
        "counted",
    )
    lines = met.where("place < 0").select(*KEY, "place", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("mark"))
    runs_of = stage(
        met.where("place >= 0")
        .join(counted.hint("shuffle_hash"), "unit")
        .select(*KEY, "place", "n", "mark")
        .unionByName(lines)
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("place", "n", "mark")).alias("units"))
        .mapInArrow(_run_rows(min_words), f"doc_id long, text_digest long, spans {SPANS}, lines {SPANS}"),
        "runs",
    )
    drop(shared, met, counted)
    bands, band_rows = tuned_bands(percent)
    paragraphs = stage(
        texts.join(runs_of.hint("shuffle_hash"), KEY)
        .select(*KEY, "text", "spans", "lines")
        .mapInArrow(
            _paragraph_rows(percent),
            "doc_id long, text_digest long, first long, last long, start long, end long, hi long, lo long, shingles binary",
        ),
        "paragraphs",
    )
    drop(runs_of)
    classes = stage(
        paragraphs.groupBy("hi", "lo")
        .agg(F.any_value("shingles").alias("shingles"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    # the sets of equal paragraphs are kept once from here
    places = stage(paragraphs.drop("shingles"), "places")
    drop(paragraphs)
    banded = stage(
        classes.select("node", "shingles").mapInArrow(_band_rows(bands, band_rows), "node long, size long, bands array<long>"),
        "bands",
    )
    labels = grouped(banded, lambda nodes: classes.select("node", "shingles").join(nodes, "node", "left_semi"), percent)
    placed = stage(
        places.join(
            classes.select("hi", "lo", "node")
            .join(labels, "node", "left")
            .select("hi", "lo", F.coalesce("component", "node").alias("component")),
            ["hi", "lo"],
        ).drop("hi", "lo"),
        "placed",
    )
    drop(places, banded, classes)
    own = Window.partitionBy("component", *KEY).orderBy("start", F.desc("end"))
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    merged = stage(
        placed.withColumn("head", F.when(F.coalesce(before <= F.col("start"), F.lit(True)), F.col("start")))
        .withColumn("head", F.max("head").over(own)),
        "merged",
    )
    drop(placed)
    at = F.struct(*KEY, "head")
    kept = stage(
        merged.groupBy("component")
        .agg(F.min(at).alias("place"), F.max(at).alias("other"))
        .where("place < other")
        .select("component", "place"),
        "kept",
    )
    return merged.join(kept, "component").select(
        "doc_id",
        "start",
        "end",
        F.col("first").alias("first_word"),
        (F.col("last") - F.col("first")).alias("n_words"),
        F.col("place.doc_id").alias("passage_doc"),
        F.col("place.head").alias("passage_start"),
        (at != F.col("place")).alias("removed"),
        "text_digest",
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without some of its bytes; spans may overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return b"".join([*out, text[at:]])


def _cut_rows(position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            column = part.column(position)
            data, offsets = text_bytes(column)
            spans = part.column(part.num_columns - 1).to_pylist()
            texts = column.to_pylist() if not any(spans) else [
                None if not column[i].is_valid
                else without_spans(data[offsets[i] : offsets[i + 1]].tobytes(), [(s["start"], s["end"]) for s in own or []]).decode("utf-8", "replace")
                for i, own in enumerate(spans)
            ]
            columns = part.columns[:-1]
            columns[position] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return run


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the removed passages cut out of their texts; rows and columns stay."""
    own = ["_cut_id", "_cut_digest"]
    cuts = stage(
        passages.where("removed")
        .groupBy(F.col("doc_id").alias(own[0]), F.col("text_digest").alias(own[1]))
        .agg(F.collect_set(F.struct("start", "end")).alias("_cuts")),
        "cuts",
    )
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(own[0]), F.xxhash64(F.col("text").cast("string")).alias(own[1]))
    joined = keyed.join(cuts.hint("merge"), own, "left").select(*docs.columns, "_cuts")
    return joined.mapInArrow(_cut_rows(docs.columns.index("text")), docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
