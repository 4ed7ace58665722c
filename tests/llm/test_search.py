import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from brute import UPPER, documents, edited, sentence
from wattframe.llm import search as L
from wattframe.tables import local_table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def items(spark, texts, ids=None):
    return local_table(spark, [(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)], ITEMS)


def brute(texts, ids, asked, top=20):
    counts = [(key, Counter(terms(t))) for key, t in zip(ids, texts) if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    holders = Counter(term for _, c in counts for term in c)
    rare = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h + 1))) for t, h in holders.items()}
    out = []
    for item, text in asked:
        scores = []
        for key, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(rare[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, key is None, key))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(scores[:top], 1)]
    return sorted(out, key=str)


def found(df):
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng):
    texts = [sentence(rng, rng.randrange(1, 90), 150) for _ in range(70)]
    asked = [sentence(rng, n, 150) for n in (1, 4, 12, 30, 30)] + ["Été 12-w1,w2;w3 É", "nothing of this", "w5 w5 w5 w6"]
    for i in range(5):
        texts[i * 7] += " | " + edited(rng, asked[3], i)
    texts += [texts[0]] * 25 + ["été w1", "É w2 W3", "", None, "... !", "w1\x00w2", "w9 " * 5000, "日本 w1"]
    return texts, asked


def test_agrees_with_brute_force(spark):
    texts, asked = corpus(random.Random(1))
    want = brute(texts, range(len(texts)), list(enumerate(asked)))
    docs = documents(spark, texts)
    assert found(L.ranked(docs, items(spark, asked))) == want
    assert found(L.ranked(docs.repartition(5), items(spark, asked), item_bytes=60, block_docs=7)) == want
    assert found(L.ranked(docs, items(spark, asked), top=3, block_points=50)) == brute(
        texts, range(len(texts)), list(enumerate(asked)), 3
    )


def test_ties_go_by_id_and_ids_may_be_missing_or_repeated(spark):
    texts = ["w1 w2 w3"] * 6 + ["w1 w2 w3 w4", "w9"]
    ids = [4, None, 2, 2, 9, 1, None, 3]
    asked = [(7, "w1 w2"), (None, "w9"), (7, "w4")]
    questions = items(spark, [t for _, t in asked] * 2, [i for i, _ in asked] * 2)
    assert found(L.ranked(documents(spark, texts, ids=ids), questions, top=4)) == brute(texts, ids, asked, 4)


def test_empty_tables(spark):
    docs, asked = documents(spark, ["w1", None]), items(spark, ["w1"])
    assert L.ranked(docs.limit(0), asked).collect() == []
    assert L.ranked(docs, asked.limit(0)).collect() == []
    assert L.ranked(docs, items(spark, [None, "", "!"])).collect() == []


def test_treap_finds_the_best_columns_and_leaves_out_ranges():
    rng = np.random.default_rng(2)
    grid = np.where(rng.random((40, 3000)) < 0.2, rng.integers(1, 1000, (40, 3000)), 0)
    grid[:, 1234] = 900
    rows, columns = np.nonzero(grid)
    treap = L.Treap(rows, columns, grid[rows, columns], 40, 3000)
    assert treap.most[0] == grid.max()
    for own in ([3], [0, 39], list(range(5, 20))):
        weights = np.arange(1, len(own) + 1)
        sums = (grid[own] * weights[:, None]).sum(0)
        want = sorted(((int(s), c) for c, s in enumerate(sums) if s > 0), key=lambda x: (-x[0], x[1]))
        assert treap.best(np.array(own), weights, 10) == want[:10]
        assert treap.best(np.array(own), weights, 10, least=want[4][0]) [:5] == want[:5]
    assert L.Treap(rows[:0], columns[:0], columns[:0], 1, 1).best(np.array([0]), np.array([1]), 5) == []
