"""Benchmark decontamination by spaced seeds.

A mask names which of a window's token positions count. The same few masks run over test
items and documents; equal hashes are hits, and around each hit the overlap is verified token
by token along its diagonal, so a bounded share of substituted tokens is tolerated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm.words import _GRAM, Words, mix, signed, slices, words_of

#: Six tokens count in each; the first to last position span seven to eleven tokens.
MASKS = ("1110111", "11011011", "110101011", "1101000111", "10110010011")
MIN_OVERLAP = 13
PERCENT = 80
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
COLUMNS = "doc_id long, item_id long, first_word long, n_words long, n_equal long, start long, end long"


def masked(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a mask at every place where it fits into one text, and those places."""
    span = len(mask)
    total = len(words.hashes) - span + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.full(total, np.uint64(hash_of(mask)), np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            sums += words.hashes[k : k + total] * _GRAM[k % len(_GRAM)]
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))[:total]
    at = np.flatnonzero(np.arange(total) + span <= last)
    return mix(sums[at]), at


def hash_of(mask: str) -> int:
    """A number of its own for each mask."""
    return (int(f"1{mask}", 2) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def part_masks(size: int, percent: int) -> list[str]:
    """Masks for whole items of a size: one of them sees no substitution, as long as enough words are equal."""
    parts = size * (100 - percent) // 100 + 1
    cuts = [size * k // parts for k in range(parts + 1)]
    return ["0" * a + "1" * (b - a) + "0" * (size - b) for a, b in zip(cuts[:-1], cuts[1:])]


class Items:
    """A block of test items with the hashes of all their masked windows, in order.

    Items shorter than ``min_overlap`` must occur as a whole: they have masks of their own
    length, one for each part that may be the equal one.
    """

    def __init__(
        self, ids: list[int], texts: list[str], masks: tuple[str, ...], min_overlap: int = MIN_OVERLAP, percent: int = PERCENT
    ) -> None:
        self.ids, self.percent = ids, percent
        words = words_of(pa.array(texts, pa.string()))
        self.tokens, self.bounds = words.hashes, words.bounds
        lengths = np.diff(self.bounds)
        short = np.unique(lengths[(lengths > 0) & (lengths < min_overlap)])
        self.parts = tuple(mask for n in short for mask in part_masks(int(n), percent))
        self.masks = masks + self.parts
        found = [masked(words, mask) for mask in masks]
        for mask in self.parts:
            hashes, at = masked(words, mask)
            whole = lengths[np.searchsorted(self.bounds, at, "right") - 1] == len(mask)
            found.append((hashes[whole], at[whole]))
        hashes, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]
        self.owner = np.searchsorted(self.bounds, self.at, "right") - 1
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    @classmethod
    def of(cls, state: dict) -> Items:
        items = cls.__new__(cls)
        items.__dict__.update(state)
        return items

    def hits(self, words: Words) -> np.ndarray:
        """(text, item, diagonal) of every hit, each once."""
        rows = []
        for number, mask in enumerate(self.masks):
            hashes, at = masked(words, mask)
            maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
            hashes, at = hashes[maybe], at[maybe]
            first = np.searchsorted(self.hashes, hashes, "left")
            counts = np.searchsorted(self.hashes, hashes, "right") - first
            ends = np.cumsum(counts)
            if not len(ends) or not ends[-1]:
                continue
            entry = np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)
            place = np.repeat(at, counts)
            if number >= len(self.masks) - len(self.parts):  # parts are short, so many hits are none
                good = self._equal_enough(words, place, self.at[entry], len(mask))
                entry, place = entry[good], place[good]
            text = np.searchsorted(words.bounds, place, "right") - 1
            item = self.owner[entry]
            diagonal = (place - words.bounds[text]) - (self.at[entry] - self.bounds[item])
            rows.append(np.unique(np.stack([text, item, diagonal], 1), axis=0))
        return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.int64)

    def _equal_enough(self, words: Words, place: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        good = np.zeros(len(place), bool)
        for k in range(0, len(place), 1 << 16):
            part, own = slice(k, k + (1 << 16)), np.arange(size)
            equal = words.hashes[place[part, None] + own] == self.tokens[start[part, None] + own]
            good[part] = 100 * equal.sum(1) >= self.percent * size
        return good


def longest(equal: np.ndarray, least: int, percent: int) -> tuple[int, int]:
    """Longest stretch of which ``percent`` in a hundred are equal: start and end.

    Other words at its ends are left out as far as ``least`` words remain.
    """
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 100 - percent, -percent))))
    after = np.maximum.accumulate(sums[::-1])[::-1]
    ends = np.searchsorted(-after, -sums, "right") - 1
    start = int(np.argmax(ends - np.arange(len(ends))))
    end = int(ends[start])
    while end - start > least and not equal[start]:
        start += 1
    while end - start > least and not equal[end - 1]:
        end -= 1
    return start, end


def overlaps(
    doc: np.ndarray, item: np.ndarray, diagonal: int, min_overlap: int = MIN_OVERLAP, percent: int = PERCENT
) -> list[tuple[int, int, int]]:
    """All overlaps along a diagonal, the longest first: first word in the document, length, equal words."""
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    equal = doc[low:high] == item[low - diagonal : high - diagonal]
    least = min(min_overlap, len(item))
    found, rest = [], [(0, len(equal))]
    while rest:
        a, b = rest.pop()
        if b - a < max(least, 1):
            continue
        start, end = longest(equal[a:b], least, percent)
        if end - start < max(least, 1):
            continue
        start, end = a + start, a + end
        found.append((low + start, end - start, int(np.count_nonzero(equal[start:end]))))
        rest += [(a, start), (end, b)]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """The longest overlap along a diagonal, of length 0 if there is none."""
    return next(iter(overlaps(doc, item, diagonal)), (max(0, diagonal), 0, 0))


def _overlaps(shared, min_overlap: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(shared.value)
        schema = pa.schema([(x.split()[0], pa.int64()) for x in COLUMNS.split(", ")])
        for part in slices(batches, "text"):
            words = words_of(part.column(1))
            rows = {}
            for text, item, diagonal in items.hits(words):
                a, b = words.bounds[text], words.bounds[text + 1]
                own = items.tokens[items.bounds[item] : items.bounds[item + 1]]
                base = words.offsets[text]
                for first, size, same in overlaps(words.hashes[a:b], own, int(diagonal), min_overlap, percent):
                    begin, end = words.starts[a + first], words.ends[a + first + size - 1]
                    row = (
                        part.column(0)[int(text)].as_py(), items.ids[item],
                        first, size, same, int(begin - base), int(end - base),
                    )
                    rows[(text, item, first)] = max(rows.get((text, item, first), row), row, key=lambda r: r[3:5])
            columns = zip(*rows.values(), strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    min_overlap: int = MIN_OVERLAP,
    percent: int = PERCENT,
    masks: tuple[str, ...] = MASKS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per overlap of a document with a test item, none for clean documents.

    Columns: doc_id, item_id, first_word and n_words (place in the document), n_equal (equal
    words among them), start and end (bytes of the text). An overlap is an ungapped stretch of
    ``min_overlap`` words or more, or the whole item if that is shorter, of which ``percent``
    in a hundred are equal; words compare with A-Z lower-cased. Documents are read whole and
    nothing is shuffled. The items, a stated query set, are sent to the tasks in blocks of
    about ``block_bytes``, with one pass over the documents per block.

    NULL and empty texts or items never overlap, repeated documents repeat their overlaps and
    repeated items count once, rows without an id report NULL, other columns are ignored, an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tests = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("length(text) > 0").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        own.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        shared = spark.sparkContext.broadcast(vars(Items([r.item_id for r in own], [r.text for r in own], masks, min_overlap, percent)))
        part = texts.mapInArrow(_overlaps(shared, min_overlap, percent), COLUMNS)
        found = part if found is None else found.unionByName(part)
    return found


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
