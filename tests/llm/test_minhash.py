import random

import numpy as np

from brute import documents, edited, groups, sentence, shingles, shuffled
from wattframe.llm import minhash
from wattframe.llm.components import components


def result(df):
    return {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in df.collect()}


def test_signature_is_circulant():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 50, np.uint64)
    found = minhash.signatures(hashes, np.array([0, 50]), 6)[0]
    places = minhash.scatter(hashes.astype(np.uint32))
    for k in range(6):
        assert found[k] == min(int(minhash.rank(np.array([p], np.uint32) - np.uint32(k))[0]) for p in places)


def test_both_maps_are_permutations():
    x = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(minhash.scatter(x))) == len(np.unique(minhash.rank(x.copy()))) == 1 << 20


def family(rng):
    base = sentence(rng, 150)
    return [base, *(edited(rng, base, k) for k in (1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12))]


def test_components_match_all_pairs(spark):
    rng = random.Random(5)
    texts = [t for _ in range(6) for t in family(rng)] + [sentence(rng, rng.randrange(1, 60), 30) for _ in range(60)]
    texts += [None, "", " \n\t", "one", "ONE", "one two three", "one two three", *texts[:5], "a b c d " * 300]
    texts = shuffled(texts)
    for n in (4, 5):
        sets = [shingles(t, n) for t in texts]
        expected = groups(list(range(len(texts))), sets)
        found = minhash.near_duplicates(documents(spark, texts), shingle=n).collect()
        assert len(found) == len(texts)
        for r in found:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id,
            )


def test_links_that_no_leader_has(spark, monkeypatch):
    """Chains of copies of copies, in blocks of a few documents."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    rng = random.Random(2)
    texts = [sentence(rng, 120)]
    for _ in range(14):
        texts.append(edited(rng, texts[-1], 3))
    sets = [shingles(t, 4) for t in texts]
    expected = groups(list(range(len(texts))), sets)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts), shingle=4).collect()}
    assert found == expected


def test_repeated_rows_and_missing_ids(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "a b c d e", "q r s t u"], ids=[7, 7, None, 3])
    rows = sorted(minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in rows] == [(3, 3, True), (7, 7, True), (7, 7, True), (None, None, True)]


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_components_take_few_rounds_whatever_the_order(spark, monkeypatch):
    from wattframe.llm import components as module

    staged = []

    def counted(df, purpose):
        staged.append((purpose, stage(df, purpose)))
        assert len(staged) <= 60
        return staged[-1][1]

    order = list(range(300))
    random.Random(8).shuffle(order)
    edges = list(zip(order, order[1:])) + [(500 + i, 900) for i in range(100)]  # a path, a star
    stage = module.stage
    monkeypatch.setattr(module, "stage", counted)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(300), 0), **dict.fromkeys([*range(500, 600), 900], 500)}
    assert sum(rows.count() for purpose, rows in staged if purpose == "links") <= 3 * len(edges)


def test_texts_under_one_id_are_judged_apart(spark):
    rng = random.Random(31)
    a, b = sentence(rng, 80), sentence(rng, 80)
    texts = [a, b, edited(rng, b, 1), sentence(rng, 60)]
    rows = minhash.near_duplicates(documents(spark, texts, ids=[7, 7, 3, 9])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(3, 3, True), (7, 3, False), (7, 7, True), (9, 9, True)]
    assert len({r.text_digest for r in rows}) == 4


def test_a_very_long_text(spark):
    rng = random.Random(32)
    long = sentence(rng, 400_000, 10**6)
    rows = minhash.near_duplicates(documents(spark, [long, edited(rng, long, 9), "short text"])).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 0, 2] and rows[0].n_shingles > 390_000


def test_links_that_no_leader_has_by_pairs_and_by_blocks(spark, monkeypatch):
    """Buckets of few nodes and of many in one table give the links of brute force."""
    rng = random.Random(3)
    texts = [sentence(rng, 120)]
    for _ in range(14):
        texts.append(edited(rng, texts[-1], 3))
    texts += [t for _ in range(3) for t in family(rng)]
    expected = groups(list(range(len(texts))), [shingles(t, 4) for t in texts])
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    monkeypatch.setattr(minhash, "PAIRED", 5)
    found = minhash.near_duplicates(documents(spark, texts), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
