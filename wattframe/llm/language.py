"""Language ID: a linear-chain conditional random field over words.

Every word has affix, byte n-gram and lexicon features; transitions between the languages of
neighbouring words are learned with them, from texts and from texts spliced together, so
code-switched text is labelled word by word. Forward-backward gives each word's marginals, and
a document's language is the one with the largest mean marginal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm.words import _LOWER, Words, mix, slices, words_of

DIMENSIONS = 1 << 18
SAMPLE = 250
SAMPLE_TOTAL = 4000
SAMPLE_BYTES = 200_000
MAX_LANGUAGES = 1000
SEGMENT = 128
PIECE = 16
EPOCHS = 5
UNKNOWN = "und"
SLICE = 2 << 20
MODEL_ROWS = 1 << 14


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    transitions: np.ndarray  # (from, to), before exp


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct words and, for each word, which of them it is."""
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    return first, inverse


def features(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the chosen words, one after the other, and their bounds.

    Per word: itself, its first and last one to four bytes, and all runs of three bytes with
    a mark at either end.
    """
    starts, ends = words.starts[chosen], words.ends[chosen]
    sizes = ends - starts
    wide = sizes + 2
    bounds = np.concatenate(([0], np.cumsum(wide)))
    source = np.arange(bounds[-1]) - np.repeat(bounds[:-1] + 1 - starts, wide)
    raw = _LOWER[words.data[np.clip(source, 0, max(len(words.data) - 1, 0))]].astype(np.uint64)
    raw[bounds[:-1]] = 1
    raw[bounds[1:] - 1] = 2
    triples = raw[:-2] | (raw[1:-1] << np.uint64(8)) | (raw[2:] << np.uint64(16))
    inside = np.ones(len(raw), bool)
    inside[bounds[1:] - 1] = inside[bounds[1:] - 2] = False
    at = np.flatnonzero(inside[: len(triples)]) if len(chosen) else np.zeros(0, np.int64)
    columns = [words.hashes[chosen]]
    head, tail = np.zeros(len(chosen), np.uint64), np.zeros(len(chosen), np.uint64)
    for k in range(4):
        step = np.uint64(8 * k)
        fits = k < sizes
        head = head | (np.where(fits, raw[bounds[:-1] + np.minimum(k + 1, wide - 1)], 0).astype(np.uint64) << step)
        tail = tail | (np.where(fits, raw[bounds[1:] - 1 - np.minimum(k + 1, wide - 1)], 0).astype(np.uint64) << step)
        columns += [head + np.uint64((k + 1) << 40), tail + np.uint64((k + 9) << 40)]
    fixed = mix(np.stack(columns, 1))
    counts = sizes + fixed.shape[1]
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_bounds[-1], np.uint64)
    places = out_bounds[:-1, None] + np.arange(fixed.shape[1])
    out[places] = fixed
    rest = np.ones(len(out), bool)
    rest[places] = False
    out[rest] = mix(triples[at] + np.uint64(20 << 40))
    return (out % np.uint64(DIMENSIONS)).astype(np.int32), out_bounds


def word_scores(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each distinct word by label, and which of them each word is."""
    first, inverse = distinct_words(words)
    if not len(first):
        return np.zeros((0, len(model.labels))), inverse
    numbers, bounds = features(words, first)
    return np.add.reduceat(model.weights[numbers], bounds[:-1], axis=0), inverse


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def mean_marginals(model: Model, words: Words, counted: np.ndarray) -> np.ndarray:
    """Mean marginal of each label over each text's counted words, by forward-backward.

    Texts are cut into segments that run side by side: their transfer matrices are joined
    along each text, and then every segment runs with the exact vectors at its two ends.
    """
    labels = len(model.labels)
    scores, which = word_scores(model, words)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12 if len(scores) else scores
    step = np.exp(model.transitions - model.transitions.max())
    lengths = np.diff(words.bounds)
    segments = -(-lengths // SEGMENT)
    total = int(segments.sum())
    out = np.zeros((len(lengths), labels))
    if not total:
        return out
    owner = np.repeat(np.arange(len(lengths)), segments)
    number = np.arange(total) - np.repeat(np.cumsum(segments) - segments, segments)
    begin = words.bounds[:-1][owner] + number * SEGMENT
    size = np.minimum(words.bounds[1:][owner] - begin, SEGMENT)
    order = np.argsort(-size, kind="stable")
    owner, number, begin, size = owner[order], number[order], begin[order], size[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]
    matrix = np.tile(np.eye(labels), (total, 1, 1))
    for t, m in enumerate(active):
        new = (matrix[:m] @ step) * scores[which[begin[:m] + t]][:, None, :]
        matrix[:m] = new / new.sum(axis=(1, 2), keepdims=True)
    index = np.full((len(lengths), 1), -1)
    place = np.empty(total, np.int64)
    place[np.lexsort((number, owner))] = np.arange(total)
    by_text = np.argsort(place)  # segments in text order
    first = np.cumsum(segments) - segments
    enter, leave = np.empty((total, labels)), np.ones((total, labels))
    texts = np.argsort(-segments, kind="stable")
    ahead = np.full((len(lengths), labels), 1.0 / labels)
    for j in range(int(segments.max())):
        own = texts[: int(np.searchsorted(-segments[texts], -j, "left"))]
        at = by_text[first[own] + j]
        enter[at] = ahead[own]
        ahead[own] = _unit((ahead[own][:, None, :] @ matrix[at])[:, 0])
    back = np.ones((len(lengths), labels))
    for j in range(int(segments.max()) - 1, -1, -1):
        own = texts[: int(np.searchsorted(-segments[texts], -j, "left"))]
        at = by_text[first[own] + j]
        leave[at] = back[own]
        back[own] = _unit((matrix[at] @ back[own][:, :, None])[:, :, 0])
    forward = np.empty((int(size[0]), total, labels))
    now = enter
    for t, m in enumerate(active):
        now = _unit((now[:m] @ step) * scores[which[begin[:m] + t]])
        forward[t, :m] = now
    sums, back = np.zeros((total, labels)), leave
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        sums[:m] += _unit(forward[t, :m] * back[:m]) * counted[at][:, None]
        back[:m] = _unit((scores[which[at]] * back[:m]) @ step.T)
    np.add.at(out, owner, sums)
    return out / np.maximum(np.add.reduceat(np.append(counted, 0), words.bounds[:-1]) * (lengths > 0), 1)[:, None]


def letters(words: Words) -> np.ndarray:
    """1.0 for words with a letter, of ASCII or of any other script; digits and signs are none."""
    raw = words.data
    plain = (_LOWER[raw] >= 97) & (_LOWER[raw] <= 122)

    def holds(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(which)))
        return sums[words.ends] > sums[words.starts]

    found = holds(plain)
    others = np.flatnonzero(holds(raw >= 128) & ~found)  # accents stand beside plain letters, so these are few
    if others.size:
        _, first, inverse = np.unique(words.hashes[others], return_index=True, return_inverse=True)
        texts = (raw[words.starts[i] : words.ends[i]].tobytes().decode("utf-8", "replace") for i in others[first])
        found[others] = np.array([any(map(str.isalpha, text)) for text in texts])[inverse]
    return found.astype(float)


def splices(words: Words, owner_labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences of word places and their labels, four pieces each.

    Half of them are successive words of one text, half join pieces of different texts. Labels
    whose texts are all shorter than a piece get pieces of their words, one after the other.
    """
    pieces = [
        np.arange(a + k, a + k + PIECE)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)
        for k in range(0, b - a - PIECE + 1, PIECE)
    ]
    owners = np.repeat(owner_labels, np.diff(words.bounds))
    for label in np.setdiff1d(owners, [owners[p[0]] for p in pieces]):  # short texts only, joined
        own = np.flatnonzero(owners == label)
        pieces += list(np.resize(own, (-(-len(own) // PIECE), PIECE)))
    if not pieces:
        return np.zeros((0, 4 * PIECE), np.int64), np.zeros((0, 4 * PIECE), np.int64)
    places = np.stack(pieces)
    spare = -len(places) % 4
    places = np.concatenate([places, places[rng.integers(0, len(places), spare)]])
    plain = places.reshape(-1, 4 * PIECE)
    mixed = places[rng.permutation(len(places))].reshape(-1, 4 * PIECE)
    pick = rng.permutation(len(plain))
    places = np.concatenate([plain[pick[: len(pick) // 2]], mixed[: len(pick) - len(pick) // 2]])
    text = np.searchsorted(words.bounds, places, "right") - 1
    return places, owner_labels[text]


def train(texts: list[str], langs: list[str], labels: list[str], seed: int = 11) -> Model:
    """Weights and transitions that maximise the likelihood of the labels, by AdaGrad."""
    rng = np.random.default_rng(seed)
    count = len(labels)
    weights = np.zeros((DIMENSIONS, count))
    step = np.eye(count)
    model = Model(labels, weights, step)
    words = words_of(pa.array(texts, pa.string()))
    own = np.array([labels.index(x) for x in langs], np.int64)
    places, truth = splices(words, own, rng)
    if not len(places) or count < 2:
        return model
    first, which = distinct_words(words)
    numbers, bounds = features(words, first)
    seen_w, seen_t = np.full(DIMENSIONS, 1e-6)[:, None] * np.ones(count), np.full((count, count), 1e-6)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(places)), max(1, len(places) // 256)):
            tokens, gold = which[places[batch]], truth[batch]
            used, local = np.unique(tokens, return_inverse=True)
            local = local.reshape(tokens.shape)
            sizes = bounds[used + 1] - bounds[used]
            ends = np.cumsum(sizes)
            rows = numbers[np.arange(ends[-1]) + np.repeat(bounds[used] - ends + sizes, sizes)]
            scores = np.add.reduceat(weights[rows], ends - sizes, axis=0)
            scores = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
            jump = np.exp(step - step.max())
            n, t_max = tokens.shape
            alpha = np.empty((t_max, n, count))
            now = np.full((n, count), 1.0 / count)
            for t in range(t_max):
                now = alpha[t] = _unit((now @ jump) * scores[local[:, t]])
            back, pairs = np.ones((n, count)), np.zeros((count, count))
            gamma = np.empty((t_max, n, count))
            for t in range(t_max - 1, -1, -1):
                gamma[t] = _unit(alpha[t] * back)
                right = scores[local[:, t]] * back
                if t:
                    joint = alpha[t - 1][:, :, None] * jump * right[:, None, :]
                    pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = _unit(right @ jump.T)
            error = -gamma.transpose(1, 0, 2).reshape(-1, count)
            error[np.arange(len(error)), gold.ravel()] += 1
            by_word = np.stack([np.bincount(local.ravel(), error[:, k], len(used)) for k in range(count)], 1)
            touched, at = np.unique(rows, return_inverse=True)
            spread = np.repeat(by_word, sizes, axis=0)
            slope = np.stack([np.bincount(at, spread[:, k], len(touched)) for k in range(count)], 1)
            slope -= 1e-3 * weights[touched]
            seen_w[touched] += slope**2
            weights[touched] += 0.2 * slope / np.sqrt(seen_w[touched])
            true_pairs = np.bincount((gold[:, :-1] * count + gold[:, 1:]).ravel(), minlength=count**2)
            slope = true_pairs.reshape(count, count) - pairs
            seen_t += slope**2
            step += 0.2 * slope / np.sqrt(seen_t)
    return model


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Label and mean marginal of each text; texts without a letter get ``und`` and 0."""
    if not model.labels:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    words = words_of(column)
    means = mean_marginals(model, words, letters(words))
    known = means.sum(axis=1) > 0.5
    best = means.argmax(axis=1)
    score = np.where(known, np.clip(means[np.arange(len(means)), best], 0, 1), 0.0)
    return [model.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def _trained_rows(labels: list[str]):
    """The model of all rows (text, lang) of one task, in pieces (number, weights, transitions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["lang"], r["text"]) for batch in batches for r in batch.to_pylist())
        model = train([text for _, text in rows], [lang for lang, _ in rows], labels)
        for number in range(0, DIMENSIONS, MODEL_ROWS):
            weights = model.weights[number : number + MODEL_ROWS].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([weights], pa.binary()), pa.array([model.transitions.tobytes()], pa.binary())],
                ["number", "weights", "transitions"],
            )

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled rows (text, lang).

    The classifier learns from a bounded sample, about ``sample`` different whole texts a
    language and 4000 in all, at least one each, by the hash of the text, of at most
    ``sample_bytes`` bytes each, in one task; the driver sees no text. Copies count once. Where a language has longer texts only,
    their first parts are taken. The languages are all that occur with a word; more than 1000 are refused. No labelled rows give a model
    without languages.
    """
    long = F.octet_length("text") > sample_bytes
    rows = (
        docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .where("text is not null and lang is not null")
        .select(F.when(long, F.substring("text", 1, max(sample_bytes // 4, 1))).otherwise(F.col("text")).alias("text"), "lang", long.alias("long"))
        .where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("hash", F.xxhash64("text", "lang"))
    )
    place = F.pmod("hash", F.lit(1 << 31))
    counts = (
        rows.select("lang", "long", "hash")
        .distinct()  # copies count once
        .groupBy("lang", "long")
        .agg(F.count("*").alias("texts"), F.min(place).alias("least"))
        .orderBy("lang", "long")
        .limit(2 * MAX_LANGUAGES + 2)
        .collect()
    )
    used = {r["lang"]: r for r in reversed(counts)}  # long texts where a language has no others
    if len(used) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not used:
        return Model([], np.zeros((DIMENSIONS, 0)), np.zeros((0, 0)))
    sample = min(sample, SAMPLE_TOTAL // len(used))
    bounds = {k: max(r["least"] + 1, int(min(1.0, sample / r["texts"]) * 2.0**31)) for k, r in used.items()}
    share = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    kind = F.create_map(*[F.lit(x) for k, r in used.items() for x in (k, r["long"])])
    chosen = rows.where((place < share[F.col("lang")]) & (F.col("long") == kind[F.col("lang")])).select("text", "lang").distinct()
    labels = sorted(used)
    trained = chosen.repartition(1).mapInArrow(_trained_rows(labels), "number int, weights binary, transitions binary")
    weights, transitions = np.empty((DIMENSIONS, len(labels))), np.eye(len(labels))
    for row in trained.collect():
        part = np.frombuffer(row["weights"]).reshape(-1, len(labels))
        weights[row["number"] : row["number"] + len(part)] = part
        transitions = np.frombuffer(row["transitions"]).reshape(len(labels), -1)
    return Model(labels, weights, transitions)


def _predictions(shared, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for part in slices(batches, "text", SLICE):
            langs, scores = predict(model, part.column(part.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*part.schema.names, *names],
            )

    return run


def with_language(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, the language and its mean marginal, from the text alone.

    NULL, empty and letterless texts get ``und`` and 0. Whole texts are labelled; equal texts
    get equal results, rows and other columns stay (columns of these two names are replaced),
    an empty table stays empty. The model, of a fixed size per language, is sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.transitions))
    asked = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([f"`{c}` {t}" for c, t in asked.dtypes] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    return asked.mapInArrow(_predictions(shared, names), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose checksum isn't 2 modulo 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
