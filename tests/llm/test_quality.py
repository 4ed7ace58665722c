import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brute import WORD, documents, quality_counts, sentence
from wattframe.llm import quality as Q


def corpus():
    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(1, 80), 60) for _ in range(60)]
    block = sentence(rng, 12, 50)
    texts += [f"{block} x {block} y {block}", "same " * 30, "a\nb\na\n \n\nb\n" * 4, "#* $%& |<> 1", None, "", " \t\n"]
    texts += [sentence(rng, 30, 60, "junk") for _ in range(20)] + [block, block, "é ü " * 3, sentence(rng, 8, 3)]
    return texts


def test_counts_and_ratios(spark):
    texts = corpus()
    docs = documents(spark, texts)
    good = [i for i in range(40)]
    rows = {r.doc_id: r for r in Q.judged(docs, docs.where("doc_id < 40").select("doc_id")).collect()}
    assert len(rows) == len(texts)
    flat = sorted({w for t in texts for w in WORD.findall(t or "")})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in flat], "w string").withColumn("h", F.xxhash64("w")).collect()}
    pairs = sorted({p for t in texts for w in [WORD.findall(t or "")] for p in zip(w, w[1:], strict=False)})
    two = {
        (r.a, r.b): r.h
        for r in spark.createDataFrame([(a, b, h[a], h[b]) for a, b in pairs], "a string, b string, x long, y long")
        .withColumn("h", F.xxhash64("x", "y")).collect()
    }
    def buckets(t):
        w = WORD.findall(t or "")
        return [x & (Q.BUCKETS - 1) for x in [*(h[x] for x in w), *(two[p] for p in zip(w, w[1:], strict=False))]]
    raw = Counter(b for t in texts for b in buckets(t))
    trusted = Counter(b for i in good for b in buckets(texts[i]))
    n, m, more = sum(raw.values()), sum(trusted.values()), Q.SMOOTHING * Q.BUCKETS
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_counts(t)
        own = buckets(t)
        if not own:
            assert r.score is None and not r.kept
            continue
        ratio = sum(
            math.log((trusted[b] + Q.SMOOTHING) / (m + more)) - math.log((raw[b] + Q.SMOOTHING) / (n + more)) for b in own
        ) / len(own)
        assert r.score == pytest.approx(ratio, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= Q.THRESHOLD)


def test_edge_cases(spark):
    empty = documents(spark, [])
    assert Q.judged(empty, empty).collect() == []
    docs = documents(spark, ["w " * 25, None], ids=[1, 1])
    assert Q.judged(docs, empty).count() == 2


def test_bad_labels_fall_below_good_ones(spark):
    """On the given documents the ratio tells the two labels apart."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = labels.where("quality = 1 and toxic = 0")
    rows = Q.judged(spark.read.parquet(f"{folder}/documents.parquet"), good).join(labels, "doc_id")
    share = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.9 and share[0] < 0.3
