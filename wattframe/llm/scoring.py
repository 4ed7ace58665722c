"""Language-model scores of whole documents: a smoothed unigram and a recurrent model.

Words of all training documents are counted exactly. The most frequent have a number in the
recurrent model, which is trained on all training documents: in each round every task learns
from its own part and the weights are averaged by tokens. Words without a number share one,
and are told apart by their smoothed share among those words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.llm.recurrent import END, OTHER, WORDS, Trainer, flat, initial, score_texts, unflat
from wattframe.llm.staging import stage
from wattframe.llm.words import Words, signed, slices, text_bytes, words_of

MORE = 0.1
FREQUENT = 400_000
BINS = 32  # per doubling of a count, to find the least count of a frequent word
SLICE = 4 << 20  # of numbers, two bytes each
FLUSH = 2_000_000
#: Sixteenths of the training documents that each round learns from; together all of them.
ROUNDS = ((0, 1), (1, 4), (4, 16))
PARTS = 64
END_HASH = np.uint64(0x656E64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(counts, first)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list) -> pa.RecordBatch:
        hashes, counts = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(counts)], ["word", "n"])

    parts, size = [], 0
    for part in slices(batches, "text"):
        words = words_of(part.column(0))
        hashes, counts = np.unique(np.append(words.hashes, np.full(len(words), END_HASH)), return_counts=True)
        parts.append((hashes, counts))
        size += len(hashes)
        if size > FLUSH:
            parts = [_merged(parts)]
            size = len(parts[0][0])
            if size > FLUSH // 2:
                yield out(parts)
                parts, size = [], 0
    if parts:
        yield out(parts)


class Vocabulary:
    """Frequent words by hash, in order, with their counts; some have a number in the model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.numbers = np.full(len(hashes), OTHER, np.int32)
        best = np.lexsort((self.hashes, -self.counts))
        best = best[self.hashes[best] != END_HASH][: WORDS - 2]
        self.numbers[best] = np.arange(2, 2 + len(best), dtype=np.int32)
        self.numbers[self.hashes == END_HASH] = END
        named = self.numbers != OTHER
        self.total, self.distinct = total, distinct
        self.other_total = total - int(self.counts[named].sum())
        self.other_distinct = distinct - int(named.sum())
        self.by_number = np.zeros(WORDS, np.int64)
        np.add.at(self.by_number, self.numbers[named], self.counts[named])
        self.by_number[OTHER] = self.other_total
        self.logs = np.log10(self.counts + MORE)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands among the frequent ones, and whether it does."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes

    def state(self) -> tuple:
        return self.hashes, self.counts, self.total, self.distinct


def _per_text(values: np.ndarray, words: Words) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[words.bounds[1:]] - sums[words.bounds[:-1]]


_ENCODED = (
    "row long, doc_id long, held_out boolean, part int, n_tokens long, known long, other long, logs double, "
    "other_logs double, numbers binary, rare array<long>, times array<long>"
)


def _encoded_rows(shared):
    """Every text once more as numbers of the model, an END after it, and its words without one.

    ``row`` tells rows apart, also those with equal ids and texts; ``part`` deals texts into sixteenths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            words = words_of(part.column(3))
            at, known = vocabulary.places(words.hashes)
            size = len(vocabulary.hashes)
            logs = vocabulary.logs[at] * known if size else np.zeros(len(at))
            numbers = np.where(known, vocabulary.numbers[at], OTHER) if size else np.full(len(at), OTHER)
            other = numbers == OTHER
            bounds = words.bounds + np.arange(len(words.bounds))
            stream = np.insert(numbers, words.bounds[1:], END).astype(np.uint16)
            rare = np.flatnonzero(~known)
            text = np.searchsorted(words.bounds, rare, "right") - 1
            order = np.lexsort((words.hashes[rare], text))
            text, hashes = text[order], words.hashes[rare][order]
            first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))[: len(text)])
            cuts = np.searchsorted(text[first], np.arange(len(words) + 1)).astype(np.int32)
            counts = np.diff(np.append(first, len(text)))
            columns = [
                pa.array(row + np.arange(len(words))),
                *part.columns[:3],
                pa.array(np.diff(words.bounds) + 1),
                pa.array(_per_text(known.astype(np.int64), words)),
                pa.array(_per_text(other.astype(np.int64), words)),
                pa.array(_per_text(logs, words)),
                pa.array(_per_text(logs * other, words)),
                pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(words), [None, pa.py_buffer((2 * bounds).astype(np.int64)), pa.py_buffer(stream)]
                ).cast(pa.binary()),
                pa.ListArray.from_arrays(cuts, pa.array(signed(hashes[first]))),
                pa.ListArray.from_arrays(cuts, pa.array(counts)),
            ]
            row += len(words)
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ENCODED.split(", ")])

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts of a slice, and their bounds."""
    raw, offsets = text_bytes(column)
    return np.frombuffer(raw.tobytes(), np.uint16).astype(np.int32), offsets // 2


def _training_rows(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(unflat(shared.value), rate)
        for part in slices(batches, "numbers", SLICE):
            trainer.learn(_numbers(part.column(0))[0])
        if trainer.tokens:
            pieces = np.array_split(flat(trainer.weights), PARTS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(PARTS)),
                    pa.array(np.full(PARTS, trainer.tokens)),
                    pa.array([x.tobytes() for x in pieces], pa.binary()),
                ],
                ["part", "tokens", "weights"],
            )

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    share = rows["tokens"].to_numpy() / rows["tokens"].sum()
    mean = sum(s * np.frombuffer(x, np.float32) for s, x in zip(share, rows["weights"], strict=True))
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "weights": [mean.astype(np.float32).tobytes()]})


def counted(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of all texts and of their ends; words are 64-bit hashes."""
    return stage(
        texts.select("text").mapInArrow(_count_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "words",
    )


def vocabulary_of(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """The most frequent words, at most ``frequent``, by a least count found in bins."""
    bin_ = F.floor(F.log2("n") * BINS).cast("int")
    bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))
    bins = sorted(bins.collect(), reverse=True)  # a fixed number for any count below 2^63
    least, words = None, 0
    for row in bins:
        words += row["words"]
        if words > frequent and least is not None:
            break
        least = row["bin"]
    total, distinct = sum(r["tokens"] for r in bins), sum(r["words"] for r in bins)
    chosen = counts.where(bin_ >= (least or 0)).orderBy(F.desc("n"), "word").limit(2 * frequent).toPandas()
    end = counts.where(F.col("word") == int(END_HASH)).toPandas()
    chosen = pd.concat([chosen, end]).drop_duplicates("word")
    return Vocabulary(
        chosen["word"].to_numpy(np.int64).view(np.uint64), chosen["n"].to_numpy(np.int64), int(total), int(distinct)
    )


def trained(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after all rounds; each training text is learned from once, whole."""
    spark = encoded.sparkSession
    values = flat(initial(vocabulary.by_number))
    for number, (low, high) in enumerate(ROUNDS):
        shared = spark.sparkContext.broadcast(values)
        own = encoded.where(F.col("part").between(low, high - 1)).select("numbers")
        rows = own.mapInArrow(
            _training_rows(shared, 4e-3 / (1 + number)), "part long, tokens long, weights binary"
        )
        parts = rows.groupBy("part").applyInPandas(_average, "part long, weights binary").collect()
        if parts:
            values = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(parts)])
    return values


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = unflat(shared.value)
        for part in slices(batches, "numbers", SLICE):
            model = score_texts(weights, *_numbers(part.column(part.schema.get_field_index("numbers")))) / math.log(10)
            rest = part.drop_columns(["numbers"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(model)], [*rest.schema.names, "model"])

    return run


def scored(docs: DataFrame, held_out: Column, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased) and one end. Documents where ``held_out`` isn't true are
    counted and learned from. base_score is the smoothed unigram, score the recurrent model's
    log10 probability of the whole text, its state carried from start to end; both use the
    exact counts of all words. The ``frequent`` most frequent words, a bounded table, are
    looked up in the tasks; all others meet their counts in a join, a row per document and
    different word.

    NULL and empty texts are one end. Repeated rows get equal results; without training
    documents all counts are zero and the model keeps its first weights; rows without an id
    are scored like others; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    learned = texts.where("not held_out")
    counts = counted(learned)
    vocabulary = vocabulary_of(counts, frequent)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)).cast("int").alias("part")
    encoded = stage(
        texts.select("doc_id", "held_out", part, "text").mapInArrow(
            _encoded_rows(spark.sparkContext.broadcast(vocabulary.state())), _ENCODED
        ),
        "encoded",
    )
    values = trained(encoded.where("not held_out"), vocabulary)
    light = [x.split()[0] for x in _ENCODED.split(", ") if x.split()[0] not in ("part", "numbers", "rare", "times")]
    kinds = ", ".join(x for x in _ENCODED.split(", ") if x.split()[0] in light)
    rows = encoded.select(*light, "numbers").mapInArrow(
        _score_rows(spark.sparkContext.broadcast(values)), f"{kinds}, model double"
    )
    # Ends aren't among these words, so no word is in most documents.
    rare = encoded.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    more = F.log10(F.coalesce("n", F.lit(0)) + MORE)
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * more).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    end = int(vocabulary.counts[vocabulary.hashes == END_HASH].sum())
    norm = math.log10(vocabulary.total + MORE * (vocabulary.distinct + 1))
    other_norm = math.log10(vocabulary.other_total + MORE * (vocabulary.other_distinct + 1))
    rare_logs, rare_known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + rare_known + F.lit(int(end > 0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs + math.log10(end + MORE) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + F.col("other_logs") + rare_logs - F.col("other") * other_norm).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a tenth, by checksum, is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


