import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import documents, sentence, unigram
from wattframe.llm import recurrent as R
from wattframe.llm import scoring as S


def corpus():
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        texts.append(" ".join(f"a{k} b{k}" for k in (rng.randrange(20) for _ in range(rng.randrange(5, 60)))))
    texts += [sentence(rng, 30, 500, "rare") for _ in range(30)]
    return [*texts, None, "", "Once ONCE once", texts[0], texts[0], "never " * 50]


def score(spark, texts, held, **more):
    docs = documents(spark, texts)
    rows = S.scored(docs, F.col("doc_id").isin([i for i, h in enumerate(held) if h]), **more).collect()
    return {r.doc_id: r for r in rows}


@pytest.fixture(scope="module")
def small(spark):
    texts = corpus()
    held = [i % 10 == 0 or i == len(texts) - 1 for i in range(len(texts))]
    return texts, held, score(spark, texts, held, frequent=60)


def test_base_scores_match_counting(small):
    texts, held, rows = small
    for i, (tokens, known, total, base) in enumerate(unigram(texts, held)):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_number_of_frequent_words_changes_no_base_score(spark, small):
    texts, held, rows = small
    other = score(spark, texts, held, frequent=5)
    assert all(other[i].base_score == pytest.approx(rows[i].base_score, rel=1e-9) for i in rows)
    assert all(other[i].n_known == rows[i].n_known for i in rows)


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(R, "_F", np.float64)
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in R.initial(np.ones(R.WORDS)).items()}
    x, y = rng.integers(0, R.WORDS, (6, 5)), rng.integers(0, R.WORDS, (6, 5))
    x[3, 2] = R.END
    used, h = np.ones((6, 5)), rng.normal(0, 0.3, (5, R.HIDDEN))
    slope, _, _ = R.gradients(w, x, y, used, h)
    each = R.WORDS // R.CLASSES
    places = [("inputs", (x[1, 1], c)) for c in (3, 20, 40)] + [("states", (3, c)) for c in (5, 20, 40)]
    places += [("class_weights", (2, 3)), ("class_bias", (1,)), ("word_weights", (y[0, 0] // each, y[0, 0] % each, 4)), ("word_bias", (y[0, 0] // each, 1))]
    for k, at in places:
        w[k][at] += 1e-5
        up = R.gradients(w, x, y, used, h)[2]
        w[k][at] -= 2e-5
        down = R.gradients(w, x, y, used, h)[2]
        w[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(slope[k][at], abs=1e-7)


def plain_score(w, numbers):
    """One step after the other, with the whole softmax written out."""
    h, total, before = np.zeros((1, R.HIDDEN), np.float32), 0.0, R.END
    each = w["word_bias"].shape[1]
    for y in numbers:
        h = R.step(w, np.array([before]), h)[0]
        c = h @ w["class_weights"] + w["class_bias"]
        s = h @ w["word_weights"][y // each].T + w["word_bias"][y // each]
        total += float(c[0, y // each] - np.log(np.exp(c).sum()) + s[0, y % each] - np.log(np.exp(s).sum()))
        before = y
    return total


def test_state_is_carried_over_windows_to_the_end():
    rng = np.random.default_rng(1)
    w = R.initial(rng.integers(1, 100, R.WORDS))
    w = {k: v * 3 for k, v in w.items()}
    texts = [np.append(rng.integers(1, R.WORDS, n), R.END) for n in (0, 1, 7, 150, 64, 63, 0)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for window in (1, 5, 64):
        found = R.score_texts(w, np.concatenate(texts), bounds, window)
        assert np.allclose(found, [plain_score(w, t) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    w = R.initial(np.random.default_rng(2).integers(1, 9, R.WORDS))
    h = np.repeat(np.random.default_rng(3).normal(0, 1, (1, R.HIDDEN)).astype(np.float32), R.WORDS, axis=0)
    assert np.exp(R.log_probabilities(w, h, np.arange(R.WORDS))).sum() == pytest.approx(1, abs=1e-4)


def test_training_beats_the_unigram_on_held_out_pairs():
    rng = np.random.default_rng(4)
    def stream(n):
        pairs = rng.integers(1, 20, n)
        return np.append(np.stack([2 * pairs, 2 * pairs + 1], 1).ravel(), R.END)
    learned, held = np.concatenate([stream(40) for _ in range(600)]), stream(400)
    counts = np.bincount(learned, minlength=R.WORDS)
    trainer = R.Trainer(R.initial(counts), rate=2e-2)
    for _ in range(8):
        trainer.learn(learned)
    bounds = np.array([0, len(held)])
    assert R.score_texts(trainer.weights, held, bounds)[0] > R.score_texts(R.initial(counts), held, bounds)[0] + 400


def test_rounds_cover_all_documents_once():
    assert [x for low, high in S.ROUNDS for x in range(low, high)] == list(range(16))


def test_edge_cases(spark):
    assert S.scored(documents(spark, []), F.lit(False)).collect() == []
    rows = score(spark, ["a b", None], [True, True])
    assert [(rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) for i in (0, 1)] == [(3, 0, 0), (1, 0, 0)]
    assert rows[0].base_score == 0.0 and rows[0].score < 0
    twice = S.scored(documents(spark, ["a b c"] * 2 + ["a"], ids=[1, 1, None]), F.lit(False), frequent=1).collect()
    assert len(twice) == 3 and len({r.base_score for r in twice if r.doc_id == 1}) == 1
    assert all(math.isfinite(r.score) for r in twice)
