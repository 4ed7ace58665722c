import random

import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline as P
from brute import documents, edited, groups, sentence, shingles, words
from wattframe.tables import local_table

NAMES = ["language_id", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A folder with documents and benchmark, and what was planted where."""
    rng = random.Random(21)
    fresh = lambda n: sentence(rng, n, 10**6)
    texts = [fresh(120) for _ in range(60)]
    texts[10] = texts[3]
    texts[11] = edited(rng, texts[4], 1)
    passage, item = fresh(70), fresh(30)
    for d in (20, 25, 30):
        texts[d] = f"{texts[d]} {passage} {fresh(20)}"
    texts[40] = f"{fresh(40)} {item} {fresh(40)}"
    texts += ["12 34 !!", None, ""]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = documents(spark, texts, ["en"] * len(texts), [f"s{i % 3}" for i in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    kind = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    local_table(spark, [(0, item)], kind).write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_stages_take_effect(spark, given, folder):
    sf, texts, passage = given
    assert [n for n, _ in P.STAGES] == NAMES
    docs, steps = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, apply in P.STAGES:
        columns = docs.columns
        out = apply(spark, docs, sf)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        steps.append({r.doc_id: r for r in docs.collect()})
        assert name == NAMES[-1] or docs.columns == columns
    ids = [set(s) for s in steps]
    assert ids[0] == set(range(60))
    expected = groups(list(range(60)), [shingles(texts[i], 5) for i in range(60)])
    assert ids[1] == {i for i in range(60) if expected[i] == i} == set(range(60)) - {10, 11}
    assert ids[2] == ids[1]
    assert [passage in steps[2][d].text for d in (20, 25, 30)] == [True, False, False]
    assert all(steps[2][d].text == texts[d] for d in ids[2] - {25, 30})
    assert ids[3] == ids[2] - {40}
    sizes = {d: len(words(steps[3][d].text)) for d in ids[3]}
    assert all(r.size == sizes[d] and r.copies > 0 for d, r in steps[4].items())
    assert sum(r.taken for r in steps[4].values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)
    ran = {r.doc_id: r.copies for r in P.run(spark, sf).collect()}
    assert ran == {d: r.copies for d, r in steps[4].items()}


def test_empty_and_repeated_rows(spark, given):
    sf = given[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, apply in P.STAGES:
        assert apply(spark, docs.where("false"), sf).count() == 0
    twice = docs.where("doc_id in (1, 2)").unionByName(docs.where("doc_id = 1"))
    assert sorted(r.doc_id for r in P.without_near_duplicates(spark, twice, sf).collect()) == [1, 2]
    odd = twice.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    assert {(r.lang_pred, r.score) for r in P.known_language(spark, odd, sf).collect()} == {("x", 1)}


def test_only_near_copies_go_and_not_what_shares_their_id(spark, given):
    rng = random.Random(5)
    a, b = sentence(rng, 80, 10**6), sentence(rng, 80, 10**6)
    docs = documents(spark, [a, b, edited(rng, b, 1), a, None, None], ids=[7, 7, 3, 7, None, 8])
    kept = P.without_near_duplicates(spark, docs, given[0])
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text == a) for r in kept.collect()), key=str) == sorted(
        [(7, True), (3, False), (None, False), (8, False)], key=str
    )
