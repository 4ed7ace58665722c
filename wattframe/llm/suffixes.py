"""Suffix-array dedup: bytes covered by a string of some width that also starts elsewhere.

Suffixes are sorted in two stages: those smaller than their successors are compared directly,
all others are induced by scanning the buckets of first bytes, and the common prefixes of
neighbours in the order tell which strings occur twice. So that no task sorts the corpus, each
start of a string belongs to the least hash of a gram within the string (its anchor): equal
strings have equal anchors, so only stretches of starts with one anchor must meet. Stretches
that are equal in all their bytes are one node before anything is sorted, and only anchors with
different stretches are sorted at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.llm.staging import stage
from wattframe.llm.words import _BASE, _INVERSE, _VALUES, BLOCK, U, _power_table, mix, signed, slices, text_bytes

WIDTH = 200
GRAM = 32
#: An anchor with more different stretches than this is compared by string, not sorted in one task.
STRETCHES = 4096
SORT_BYTES = 1 << 19
SEEN = 100_000
_TIES = np.random.Generator(np.random.PCG64(11)).integers(0, 256, 1 << 16, np.uint64)
_NO_TIE = U(0xFFFFFFFFFFFFFF00)
LISTS = ("anchor", "kind", "span")


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix whether it sorts before the one that starts a byte later; the last doesn't."""
    n = len(data)
    if not n:
        return np.zeros(0, bool)
    changes = np.flatnonzero(data[1:] != data[:-1])
    rises = np.append(data[1:][changes] > data[:-1][changes], False)
    return rises[np.searchsorted(changes, np.arange(n))]


def needed(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes and those behind them that their places are induced from."""
    n = len(small)
    ends = np.append(np.flatnonzero(small), n - 1)
    starts = np.flatnonzero(wanted)
    until = np.maximum(ends[np.searchsorted(ends, starts)], starts)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, until + 1, -1)
    return np.cumsum(steps[:n]) > 0


def suffix_order(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted suffixes of the bytes, all if not told, in order of at least ``depth`` bytes."""
    n = len(data)
    small = smaller_than_next(data)
    kept = np.ones(n, bool) if wanted is None else needed(small, wanted)
    big = kept & ~small
    raw = data.tobytes().decode("latin-1")
    # First stage: compare the suffixes that are smaller than their successors.
    direct = sorted((raw[i : i + depth], i) for i in np.flatnonzero(small & kept).tolist())
    direct = np.fromiter((i for _, i in direct), np.int64, len(direct))
    firsts = data[direct]
    # Second stage: all others follow from the suffixes a byte later, which stand before them.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and kept[-1]:
        waiting[data[-1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        generation = waiting[byte]
        here = []
        while generation:
            now = np.concatenate(generation)
            here.append(now)
            before = now[now > 0] - 1
            before = before[(data[before] == byte) & big[before]]
            generation = [before] if before.size else []
        low, high = np.searchsorted(firsts, [byte, byte + 1]) if firsts.size else (0, 0)
        here.append(direct[low:high])
        bucket = np.concatenate(here)
        if not bucket.size:
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > byte) & big[before]]
        heads = data[before]
        by_head = np.argsort(heads, kind="stable")
        before, heads = before[by_head], heads[by_head]
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        for part in np.split(before, cuts) if before.size else []:
            waiting[data[part[0]]].append(part)
    whole = np.concatenate(order) if order else np.zeros(0, np.int64)
    return whole if wanted is None else whole[wanted[whole]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, up to ``depth``."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    eights = np.ndarray(len(padded) - 8, ">u8", padded.data, strides=(1,))
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b, left = order[:-1], order[1:], np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = eights[a + at].astype(np.uint64) ^ eights[b + at].astype(np.uint64)
        other = differ != 0
        if other.any():
            bytewise = differ[other].astype(">u8").view(np.uint8).reshape(-1, 8)
            out[left[other]] = at + (bytewise != 0).argmax(1)
        a, b, left = a[~other], b[~other], left[~other]
        out[left] = at + 8
        if not left.size:
            break
    room = len(data) - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(np.minimum(out[1:], depth), room)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of ``width`` values."""
    n = len(values)
    full = np.full(-(-n // width) * width, U(0xFFFFFFFFFFFFFFFF))
    full[:n] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Starts of strings by anchor: text, first and last start (in bytes of the text), anchor, kind, again.

    Every start of a whole string is in exactly one stretch. The anchor depends on nothing but
    the string. Stretches of one kind are equal in all bytes from the first start to the end of
    the last string; ``again`` is 1 where a stretch may repeat a string within itself. Among
    equal grams one is picked by place, so repetitive texts don't get a stretch for each byte.
    """
    reach = width - gram + 1
    found: dict[str, list] = {k: [] for k in ("text", "first", "last", "anchor", "kind", "again")}
    for base in range(0, max(len(data) - width + 1, 0), BLOCK - width + 1):
        block = data[base : base + BLOCK]
        size = len(block)
        if size < width:
            break
        sums = np.zeros(size + 1, np.uint64)
        values = _VALUES[block]
        values *= _power_table(_BASE, size)[:size]
        np.cumsum(values, out=sums[1:])
        back = _power_table(_INVERSE, size)
        place = np.arange(base, base + size)
        text = np.searchsorted(offsets, place, "right") - 1 if len(offsets) < 3 else np.repeat(
            np.arange(len(offsets) - 1), np.diff(np.clip(offsets, base, base + size))
        )
        grams = mix((sums[gram:] - sums[:-gram]) * back[: size - gram + 1])
        grams &= _NO_TIE
        grams |= _TIES[(place - offsets[text])[: len(grams)] & 0xFFFF]
        least = _least(grams, reach)
        starts = np.flatnonzero(offsets[text + 1][: len(least)] - place[: len(least)] >= width)
        if not starts.size:
            continue
        own = least[starts]
        cut = np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        first = starts[np.concatenate(([0], cut))]
        last = starts[np.concatenate((cut - 1, [len(starts) - 1]))]
        while first.size:
            anchor = least[first]
            at, again = np.empty_like(first), np.empty_like(first)
            for k in range(0, len(first), 4096):
                part = slice(k, k + 4096)
                at[part] = first[part] + (grams[first[part, None] + np.arange(reach)] == anchor[part, None]).argmax(1)
                after = np.minimum(at[part, None] + np.arange(1, reach), len(grams) - 1)
                alike = (grams[after] ^ anchor[part, None]) <= U(0xFF)
                again[part] = (alike & (after > at[part, None])).any(1)
            end = np.minimum(at, last)
            whole = (sums[end + width] - sums[first]) * back[first]
            kind = mix(mix(whole + (end - first).astype(np.uint64)) + (at - first).astype(np.uint64))
            found["text"].append(text[first])
            found["first"].append(first + base)
            found["last"].append(end + base)
            found["anchor"].append((anchor >> U(8)).view(np.int64))
            found["kind"].append(signed(kind))
            found["again"].append(again)
            rest = end < last
            first, last = end[rest] + 1, last[rest]
    out = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}
    order = np.argsort(out["first"], kind="stable")
    out = {k: v[order] for k, v in out.items()}
    for k in ("first", "last"):
        out[k] = out[k] - offsets[out["text"]]
    return out


def packed(first: np.ndarray, last: np.ndarray, again: np.ndarray) -> np.ndarray:
    """First start, number of starts after it, and the flag, in one number."""
    return (first << 32) | ((last - first) << 1) | again


def _unpacked() -> dict[str, Column]:
    first = F.shiftright("span", 32)
    return {"first": first, "last": first + F.shiftright(F.col("span").bitwiseAND(0xFFFFFFFF), 1)}


def text_key(text: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(text).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def _key_columns(text: Column) -> dict[str, Column]:
    digest = F.sha2(text, 256)
    return {
        "k1": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"),
        "k2": F.conv(F.substring(digest, 16, 15), 16, 10).cast("long"),
    }


_STRETCHES = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64())]
    + [(k, pa.list_(pa.int64())) for k in LISTS]
)


def _all_stretches(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column(0))
            keys = [text_key(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            new = np.zeros(len(keys), bool)
            for i, key in enumerate(keys):
                new[i] = key not in seen
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            found = stretches(data, offsets, width, gram)
            found["span"] = packed(found["first"], found["last"], found["again"])
            keep = new[found["text"]]
            bounds = np.searchsorted(found["text"][keep], np.arange(len(keys) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(found[k][keep])) for k in LISTS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(np.diff(offsets)), *lists],
                schema=_STRETCHES,
            )

    return run


_BODIES = "anchor long, kind long, n long, k1 long, k2 long, first long, last long, body binary"


def _bodies(width: int):
    """Bytes of the wanted stretches; of crowded anchors a row for each string, with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if key == previous:  # another copy of the text
                    continue
                previous = key
                text = batch.column(2)[row].as_buffer()
                text = memoryview(text) if text is not None else b""
                for w in batch.column(3)[row].as_py():
                    first, last = w["first"], w["last"]
                    if not w["crowded"]:
                        rows.append((w["anchor"], w["kind"], w["n"], *key, first, last, bytes(text[first : last + width])))
                        continue
                    for start in range(first, last + 1):
                        digest = hashlib.sha256(text[start : start + width]).digest()
                        pair = (int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))
                        rows.append((*pair, w["n"], *key, start, start, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=[x.split()[0] for x in _BODIES.split(", ")],
            )

    return run


def repeated_starts(bodies: list[bytes], width: int) -> list[np.ndarray]:
    """For each body the starts of strings that also start at another place of the bodies."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    bases = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    owner = np.repeat(np.arange(len(bodies)), lengths)
    inside = np.arange(len(data)) + width <= bases[owner + 1]
    order = suffix_order(data, width, inside)
    same = common_prefixes(data, order, width) >= width
    twice = same.copy()
    twice[:-1] |= same[1:]
    hits = np.sort(order[twice])
    cuts = np.searchsorted(hits, bases)
    return [hits[a:b] - base for a, b, base in zip(cuts[:-1], cuts[1:], bases)]


def _sort_bodies(width: int):
    """Places of repeated strings, from bodies that come in order of anchor and kind."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        if rows:
            for row, hits in zip(rows, repeated_starts([r[7] for r in rows], width)):
                if row[2] > 1 or not hits.size:
                    continue
                cut = np.flatnonzero(np.diff(hits) > 1)
                for a, b in zip(np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(hits) - 1]))):
                    out.append((row[3], row[4], row[5] + int(hits[a]), row[5] + int(hits[b])))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["k1", "k2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if size >= SORT_BYTES and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[7])
        if rows:
            yield flush(rows)

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            spans, kept = [], []
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                packed = np.array(batch.column(2)[row].as_py() or [], np.int64)
                packed.sort()
                first, end = packed >> 32, (packed & 0xFFFFFFFF) + width
                if first.size:
                    end = np.maximum.accumulate(end)
                    new = np.flatnonzero(first[1:] > end[:-1]) + 1
                    first, end = first[np.concatenate(([0], new))], end[np.concatenate((new - 1, [len(end) - 1]))]
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(first, end)])
                edges = [0, *np.stack([first, end], 1).ravel().tolist(), int(b - a)]
                kept.append(b"".join(data[a + s : a + e].tobytes() for s, e in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def repeated_bytes(docs: DataFrame, width: int = WIDTH, crowded: int = STRETCHES) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (start and end of what goes, in bytes), kept (bytes).

    A byte goes if it lies in a string of ``width`` bytes that also starts at any other place,
    in the same text or another, overlapping or not; strings are judged on the input and never
    cross texts. Texts are taken whole, as UTF-8; very long ones are read in blocks, and one
    text, its stretches and its spans must fit a task. An anchor with more than ``crowded``
    different stretches is compared by the digests of its strings, which Spark counts, so no
    group grows with the data. NULL and empty texts and texts shorter than ``width`` keep all,
    equal texts (repeated rows too) lose all, ids may repeat or be NULL, other columns are
    ignored, an empty table gives no rows.
    """
    gram = max(1, min(GRAM, width // 4))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    near = stage(
        texts.select("text").mapInArrow(
            _all_stretches(width, gram),
            "k1 long, k2 long, n_bytes long, " + ", ".join(f"{k} array<long>" for k in LISTS),
        ),
        "stretches",
    )
    each = near.select("k1", "k2", F.inline(F.arrays_zip(*LISTS)))
    kinds = stage(
        each.groupBy("anchor", "kind").agg(
            F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "span"))
        ),
        "kinds",
    )
    several = (
        kinds.groupBy("anchor")
        .agg(F.count("*").alias("kinds"), F.max(F.col("span").bitwiseAND(1)).alias("within"))
        .where("kinds > 1 or within = 1")
    )
    rivals = kinds.join(several, "anchor").withColumns(_unpacked() | {"crowded": F.col("kinds") > crowded})
    wanted = rivals.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "kind", "n", "first", "last", "crowded")).alias("wanted")
    )
    keyed = texts.withColumns(_key_columns(F.col("text")))
    bodies = stage(
        keyed.select("k1", "k2", F.col("text").cast("binary").alias("text"))
        .join(wanted.hint("merge"), ["k1", "k2"])
        .mapInArrow(_bodies(width), _BODIES),
        "bodies",
    )
    places = ["k1", "k2", "first", "last"]
    by_order = (
        bodies.where("body is not null")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "kind")
        .mapInArrow(_sort_bodies(width), "k1 long, k2 long, first long, last long")
    )
    strings = bodies.where("body is null")
    by_digest = strings.where("n = 1").join(
        strings.groupBy("anchor", "kind").agg(F.count("*").alias("c")).where("c > 1"), ["anchor", "kind"]
    )
    by_kind = each.join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"]).withColumns(_unpacked())
    copies = (
        near.groupBy("k1", "k2", "n_bytes").agg(F.count("*").alias("c")).where(f"c > 1 and n_bytes >= {width}")
        .select("k1", "k2", F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - width).alias("last"))
    )
    found = by_order.select(*places)
    for part in (by_digest, by_kind, copies):
        found = found.unionByName(part.select(*places))
    spans = found.groupBy("k1", "k2").agg(
        F.collect_set(F.shiftleft("first", 32).bitwiseOR(F.col("last"))).alias("spans")
    )
    return (
        keyed.join(spans.hint("merge"), ["k1", "k2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut(width), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    )


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from each document and the digest of what is kept."""
    cut = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
