"""Ranked lexical search: a K2-treap over the grid of terms and documents, descended best-first.

The grid has a row for each term asked for and a column for each document of a block; a point
holds the impact of the term on the document. The treap halves rows and columns level by level:
a cell that holds any point stores which of its four quarters do, and the greatest impact in it.
An item follows the paths of all its rows at once, range of documents by range of documents,
always the ranges whose summed maxima promise most, until none can reach its results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattframe.llm.staging import stage
from wattframe.llm.words import slices, words_of

TOP = 20
BLOCK_DOCS = 1 << 14
BLOCK_POINTS = 1 << 20
ITEM_BYTES = 4 << 20
AT_ONCE = 128

#: Bytes outside terms: all of ASCII but digits and letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
for _first, _last in (b"09", b"AZ", b"az"):
    OUTSIDE[_first : _last + 1] = False
_QUARTERS = np.array([bin(k).count("1") for k in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^32 at even places."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Points (row, column, value above 0) as cells from the whole grid down to single points.

    ``most`` is the greatest value in a cell, ``mask`` has a bit for each quarter with points
    (row half, then column half), ``child`` is the place of a cell's first quarter.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int):
        self.levels = max((n_rows - 1).bit_length(), (n_columns - 1).bit_length(), 1)
        codes = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(codes)
        codes, most = codes[order], values[order]
        levels = [(most, np.zeros(len(codes), np.uint8))]
        for _ in range(self.levels):
            quarter = np.left_shift(1, (codes & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            codes = codes >> np.uint64(2)
            heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(most, heads) if len(heads) else most
            mask = np.bitwise_or.reduceat(quarter, heads) if len(heads) else quarter
            codes = codes[heads]
            levels.append((most, mask))
        levels.reverse()
        self.most = np.concatenate([m for m, _ in levels])
        self.mask = np.concatenate([m for _, m in levels])
        sizes = _QUARTERS[self.mask]
        self.child = len(levels[0][0]) + np.cumsum(sizes) - sizes

    def best(
        self, rows: np.ndarray, weights: np.ndarray, top: int, least: int = 1, at_once: int = AT_ONCE
    ) -> list[tuple[int, int]]:
        """The ``top`` columns by weighted sum of the rows' values: (sum, column), sums from ``least`` on.

        Equal sums go by column.
        """
        if not len(self.most) or not len(rows):
            return []
        cells = np.zeros((1, len(rows)), np.int64)
        bound = np.array([int((self.most[0] * weights).sum())])
        level, column = np.array([self.levels]), np.array([0])
        best: list[tuple[int, int]] = []
        floor, beyond = least, None
        while True:
            open_ = bound >= floor
            if beyond is not None:
                open_ &= (bound > floor) | ((column << level) < beyond)
            if not open_.any():
                return [(s, c) for s, c in best]
            bound, level, column, cells = bound[open_], level[open_], column[open_], cells[open_]
            if len(bound) > at_once:
                first = np.zeros(len(bound), bool)
                first[np.argpartition(-bound, at_once)[:at_once]] = True
            else:
                first = np.ones(len(bound), bool)
            leaf = first & (level == 0)
            if leaf.any():
                found = [*best, *zip(bound[leaf].tolist(), column[leaf].tolist())]
                best = sorted(found, key=lambda x: (-x[0], x[1]))[:top]
                if len(best) == top:
                    floor, beyond = best[-1]
            inner = first & (level > 0)
            new = [(bound[~first], level[~first], column[~first], cells[~first])]
            if inner.any():
                here, depth = cells[inner], level[inner]
                known = here >= 0
                mask = np.where(known, self.mask[here], 0).astype(np.int64)
                half = ((rows[None, :] >> (depth[:, None] - 1)) & 1) * 2
                for side in (0, 1):
                    quarter = half + side
                    has = (mask >> quarter) & 1 == 1
                    place = self.child[here] + _QUARTERS[mask & ((1 << quarter) - 1)]
                    place = np.where(has, place, -1)
                    sums = (np.where(has, self.most[place], 0) * weights).sum(1)
                    new.append((sums, depth - 1, column[inner] * 2 + side, place))
            bound, level, column, cells = (np.concatenate(x) for x in zip(*new))


class Items:
    """Texts to look for: the terms of all of them, and for each its terms and how often it has them."""

    def __init__(self, ids: list, texts: list[str]):
        words = words_of(pa.array(texts, pa.string()), outside=OUTSIDE)
        self.ids = ids
        self.vocabulary, rows = np.unique(words.hashes, return_inverse=True)
        self.rows, self.weights = [], []
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            own, often = np.unique(rows[a:b], return_counts=True)
            self.rows.append(own.astype(np.int64))
            self.weights.append(often.astype(np.int64))


def _points(shared):
    """Per document with a term: number of terms, and places and counts of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        size = max(len(vocabulary), 1)
        for part in slices(batches, "text"):
            words = words_of(part.column(1), outside=OUTSIDE)
            n = np.diff(words.bounds)
            if len(vocabulary):
                place = np.searchsorted(vocabulary, words.hashes)
                place[place == len(vocabulary)] = 0
                known = vocabulary[place] == words.hashes
            else:
                place, known = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes), bool)
            text = np.repeat(np.arange(len(n)), n)
            cell, often = np.unique(text[known] * size + place[known], return_counts=True)
            bounds = np.searchsorted(cell, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in ((cell % size).astype(np.int32), often.astype(np.int32))]
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "often"])
            yield out.filter(pa.array(n > 0))

    return run


def _found(shared, top: int, block_docs: int, block_points: int):
    """The best documents of a task for each item, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        best: list[list] = [[] for _ in items.ids]  # (-score, no id, id)

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks().sort_by([("doc_id", "ascending")])
            ids = table["doc_id"].to_pylist()  # those without an id come last
            lists = table["terms"].combine_chunks()
            columns = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            rows = lists.flatten().to_numpy().astype(np.int64)
            often = table["often"].combine_chunks().flatten().to_numpy().astype(np.int64)
            norm = 75 + 25 * table["n"].to_numpy() * n_docs // n_terms
            values = weights[rows] * (1_000_000_000 * often // (1000 * often + 12 * norm[columns]))
            good = values > 0
            treap = Treap(rows[good], columns[good], values[good], len(weights), len(ids))
            for slot, own in enumerate(best):
                least = -own[-1][0] if len(own) == top else 1
                for score, column in treap.best(items.rows[slot], items.weights[slot], top, max(least, 1)):
                    own.append((-score, ids[column] is None, ids[column] or 0))
                own.sort()
                del own[top:]

        parts, docs, points = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                parts.append(part)
                docs += part.num_rows
                points += len(part.column(2).flatten())
                if docs >= block_docs or points >= block_points:
                    search(parts)
                    parts, docs, points = [], 0, 0
        if parts:
            search(parts)
        rows = [(slot, items.ids[slot], None if none else key, -score) for slot, own in enumerate(best) for score, none, key in own]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns], names=["slot", "item_id", "doc_id", "score"]
        )

    return run


def ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
    block_docs: int = BLOCK_DOCS,
    block_points: int = BLOCK_POINTS,
) -> DataFrame:
    """The ``top`` documents for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of digits, letters of ASCII (A-Z lower-cased) and all characters beyond it.
    Scores are whole numbers: rarity of a term times its saturated count, summed over the item's
    terms with repeats; only scores above 0 count, and equal ones go by doc_id (those without an
    id last). Documents are read once per ``item_bytes`` of items, the stated query set, and
    kept as points of terms that are asked for; a treap holds up to ``block_docs`` documents or
    about ``block_points`` points. Every task gives ``top`` documents an item at most, so only
    those are shuffled.

    NULL and empty texts have no terms and don't count as documents; very long texts count
    whole; repeated documents are ranked one by one; rows of items with equal id and text are
    one item, those with equal id and another text are ranked apart; other columns are
    ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("length(text) > 0").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // item_bytes))
    found = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        own.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        chosen = Items([r.item_id for r in own], [r.text for r in own])
        vocabulary = spark.sparkContext.broadcast(chosen.vocabulary)
        points = stage(
            texts.mapInArrow(_points(vocabulary), "doc_id long, n long, terms array<int>, often array<int>"), "points"
        )
        n_docs, n_terms = points.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = np.zeros(len(chosen.vocabulary), np.int64)
        for term, n in points.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            holders[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(h) + 1))) for h in holders], np.int64)
        shared = spark.sparkContext.broadcast((chosen, weights, n_docs, max(n_terms, 1)))
        rows = points.mapInArrow(
            _found(shared, top, block_docs, block_points), "slot long, item_id long, doc_id long, score long"
        )
        order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        rows = rows.select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT r, doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM docs),
counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
rare AS (
  SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
sizes AS (SELECT r, doc_id, 100 - 25 + ((25 * n * nd) // nt) AS m FROM docs, totals),
items AS (SELECT row_number() OVER () AS slot, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (
  SELECT slot, item_id, unnest(
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM items),
scored AS (
  SELECT slot, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN rare USING (term) JOIN sizes USING (r)
  GROUP BY slot, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 20
"""
