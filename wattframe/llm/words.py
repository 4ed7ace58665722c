"""Words of whole texts as arrays: positions, 64-bit hashes and n-grams, for Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomial sums over
bytes with random 64-bit values per byte, then mixed; they depend on nothing but the word,
so every task and every run agrees. Work is done in blocks, so memory beyond the batch stays
at a few arrays of a block plus about 24 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
SLICE_BYTES = 2 << 20
U = np.uint64

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, BLOCK + 1), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@dataclass
class Words:
    """The words of some texts; text i has words ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # in bytes of the slice
    ends: np.ndarray
    data: np.ndarray  # bytes of the slice, as they are
    offsets: np.ndarray  # bytes of text i are offsets[i]:offsets[i + 1]

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def words_of(
    column: pa.Array, lower: bool = True, data: np.ndarray | None = None, outside: np.ndarray = _SPACES
) -> Words:
    """All words of all texts of a column, A-Z lower-cased in the hashes unless told not to.

    ``outside`` tells for each byte whether it lies between words.
    """
    raw, offsets = text_bytes(column)
    if data is not None:
        raw = data
    inner = ~outside[raw]
    heads = np.zeros(len(raw) + 1, bool)
    heads[offsets] = True
    before = np.empty_like(inner)
    before[:1] = False
    before[1:] = inner[:-1]
    before &= ~heads[:-1]
    starts = np.flatnonzero(inner & ~before)
    after = np.empty_like(inner)
    after[-1:] = False
    after[:-1] = inner[1:]
    after &= ~heads[1:]
    ends = np.flatnonzero(inner & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + BLOCK, "right")), first + 1)
        size = int(ends[last - 1]) - base
        block = raw[base : base + size]
        sums = np.zeros(size + 1, np.uint64)
        values = _VALUES[_LOWER[block] if lower else block]
        values *= _power_table(_BASE, size)[:size]
        np.cumsum(values, out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        part = (sums[e] - sums[s]) * _power_table(_INVERSE, size)[s]
        hashes[first:last] = mix(part + (e - s).astype(np.uint64))
        first = last
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, raw, offsets)


def grams(words: Words, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words and their bounds by text.

    With ``whole``, a text of fewer words, but one at least, gives its whole sequence as one.
    """
    lengths = np.diff(words.bounds)
    counts = np.maximum(lengths - n + 1, 0)
    total = len(words.hashes) - n + 1
    if total > 0:
        sums = words.hashes[:total] * _GRAM[0]
        for k in range(1, n):
            sums += words.hashes[k : k + total] * _GRAM[k]
        last = np.repeat(words.bounds[1:], lengths)[:total]
        sums = mix(sums[np.arange(total) + n <= last])
    else:
        sums = np.zeros(0, np.uint64)
    if whole and (short := np.flatnonzero((lengths > 0) & (lengths < n))).size:
        own = np.empty(len(short), np.uint64)
        for i, text in enumerate(short):
            h = words.hashes[words.bounds[text] : words.bounds[text + 1]]
            own[i] = (h * _GRAM[: len(h)]).sum(dtype=np.uint64) ^ U(len(h))
        at = np.concatenate(([0], np.cumsum(counts)))[short]
        sums = np.insert(sums, at, mix(own))
        counts[short] = 1
    return sums, np.concatenate(([0], np.cumsum(counts)))


def sets_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, and their bounds."""
    hashes = hashes[: bounds[-1]].copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    own = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
    own[bounds[:-1][np.diff(bounds) > 0]] = True
    return hashes[own], np.concatenate(([0], np.cumsum(own)))[bounds]


def reduce_by_text(reducer: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``reducer`` over each text's values; ``empty`` for texts without any."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if full.size:
        out[full] = reducer.reduceat(values, bounds[:-1][full])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ordered arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return hashes.view(np.int64)
