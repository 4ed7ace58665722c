import os
import random

import numpy as np
import pyarrow as pa
import pytest

from brute import documents, sentence
from wattframe.llm import language as L
from wattframe.llm.words import words_of

LANGS = {"aa": "bcd", "ee": "fgh", "oo": "klm"}


def speak(rng, lang, n):
    return " ".join(
        "".join(rng.choice(LANGS[lang]) + lang[0] for _ in range(rng.randrange(1, 4))) for _ in range(n)
    )


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [k for k in LANGS for _ in range(15)]
    return L.train([speak(rng, k, 120) for k in langs], langs, sorted(LANGS))


def plain_marginals(model, text):
    """Marginals of each word, one step after the other."""
    words = words_of(pa.array([text]))
    scores, which = L.word_scores(model, words)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    e, t = e[which], np.exp(model.transitions - model.transitions.max())
    n, k = e.shape
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    now = np.full(k, 1 / k)
    for i in range(n):
        now = (now @ t) * e[i]
        now = alpha[i] = now / now.sum()
    for i in range(n - 2, -1, -1):
        beta[i] = t @ (e[i + 1] * beta[i + 1])
        beta[i] /= beta[i].sum()
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def test_segments_give_the_plain_marginals(model, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(speak(rng, rng.choice(list(LANGS)), rng.randrange(1, 9)) for _ in range(n)) for n in (1, 5, 40)]
    texts = [texts[0], None, texts[1], "", texts[2], "12 34 --"]
    for size in (3, 7, 128):
        monkeypatch.setattr(L, "SEGMENT", size)
        words = words_of(pa.array(texts, pa.string()))
        means = L.mean_marginals(model, words, np.ones(len(words.hashes)))
        for i, t in enumerate(texts):
            if t:
                assert np.allclose(means[i], plain_marginals(model, t).mean(axis=0), atol=1e-9)


def test_switches_within_a_text_are_followed(model):
    rng = random.Random(3)
    text = f"{speak(rng, 'aa', 30)} {speak(rng, 'oo', 30)}"
    best = plain_marginals(model, text).argmax(axis=1)
    truth = np.repeat([0, 2], 30)
    assert (best == truth).mean() > 0.95
    assert model.transitions.diagonal().mean() > model.transitions.mean()


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(LANGS)) for _ in range(80)]
    texts = [speak(rng, k, rng.randrange(20, 90)) for k in langs]
    docs = documents(spark, [*texts, None, "", "123 !!", texts[0], texts[0]], [*langs, None, "aa", None, None, None])
    model = L.fit(docs.where("doc_id < 50"))
    rows = {r.doc_id: r for r in L.with_language(docs, model).collect()}
    assert np.mean([rows[i].lang_pred == langs[i] for i in range(50, 80)]) >= 0.9
    assert [(rows[i].lang_pred, rows[i].score) for i in (80, 81, 82)] == [("und", 0.0)] * 3
    assert rows[83].score == rows[84].score == pytest.approx(rows[0].score)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_without_labels_or_rows(spark):
    docs = documents(spark, ["aa bb", None])
    model = L.fit(docs)
    assert model.labels == []
    assert [r.lang_pred for r in L.with_language(docs, model).collect()] == ["und", "und"]
    assert L.with_language(documents(spark, []), model).count() == 0
    one = L.fit(documents(spark, ["ab ab " * 20, "cd"], ["x", None]))
    assert [r.lang_pred for r in L.with_language(docs, one).collect()] == ["x", "und"]


def test_features_of_single_bytes():
    words = words_of(pa.array(["a Ab é"]))
    first, _ = L.distinct_words(words)
    numbers, bounds = L.features(words, first)
    assert np.diff(bounds).tolist() == [9 + n for n in (words.ends - words.starts)[first]]
    assert numbers.min() >= 0 and numbers.max() < L.DIMENSIONS
    assert sentence(random.Random(0), 2)


def test_copies_short_and_long_texts_leave_no_language_untrained(spark):
    rng = random.Random(5)
    texts = [speak(rng, "aa", 60) for _ in range(30)]
    langs = ["aa"] * 30
    few = [speak(rng, "ee", 60) for _ in range(3)]
    texts += [few[i % 3] for i in range(3000)] + [speak(rng, "oo", 7) for _ in range(40)]
    langs += ["ee"] * 3000 + ["oo"] * 40
    new = {"uu": "npq", "ii": "rst"}
    say = lambda k, n: " ".join("".join(rng.choice(new[k]) + k[0] for _ in range(2)) for _ in range(n))
    texts += [say("uu", 800), *[say("ii", 60) for _ in range(20)]]
    langs += ["uu", *["ii"] * 20]
    model = L.fit(documents(spark, texts, langs), sample=5, sample_bytes=2000)
    assert model.labels == ["aa", "ee", "ii", "oo", "uu"]
    asked = [*(speak(rng, k, 30) for k in ("aa", "ee", "oo")), say("ii", 30), say("uu", 30)]
    assert L.predict(model, pa.array(asked))[0] == ["aa", "ee", "oo", "ii", "uu"]


def test_signs_and_digits_are_no_letters(spark, model):
    texts = ["— 12 … € 50", "🙂 🎉🎉", "„12“ ± ½ °", "Ж", "日本", "é", "— word —"]
    rows = L.with_language(documents(spark, texts), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False, False, False]
    assert all(r.score == 0 for r in rows[:3]) and all(0 < r.score <= 1 for r in rows[3:])


def test_training_runs_in_a_task(spark, folder, monkeypatch):
    rng = random.Random(6)
    langs = [k for k in LANGS for _ in range(4)]
    docs = documents(spark, [speak(rng, k, 60) for k in langs], langs)
    plain = L.train

    def noted(*args):
        with open(f"{folder}/pid", "w") as file:
            file.write(str(os.getpid()))
        return plain(*args)

    monkeypatch.setattr(L, "train", noted)
    model = L.fit(docs)
    with open(f"{folder}/pid") as file:
        assert int(file.read()) != os.getpid()
    rows = sorted(docs.select("lang", "text").collect())
    same = plain([r.text for r in rows], [r.lang for r in rows], sorted(LANGS))
    assert np.array_equal(model.weights, same.weights) and np.array_equal(model.transitions, same.transitions)
