import random

import numpy as np
from pyspark.sql import types as T

from brute import documents, edited, sentence, words
from wattframe.llm import contamination as C
from wattframe.tables import local_table

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def items(spark, texts):
    return local_table(spark, [(i, t, "x") for i, t in enumerate(texts)], ITEMS)


def brute(texts, tests):
    """(doc, item) pairs with a good stretch on any diagonal at all."""
    names = {}
    number = lambda t: np.array([names.setdefault(w, len(names)) for w in words(t)], np.int64)
    a, b = [number(t) for t in texts], [number(t) for t in tests]
    found = set()
    for d, doc in enumerate(a):
        for i, item in enumerate(b):
            for diagonal in range(-len(item) + 1, len(doc)):
                _, size, same = C.overlap(doc, item, diagonal)
                if size and size >= min(C.MIN_OVERLAP, len(item)) and 100 * same >= C.PERCENT * size:
                    found.add((d, i))
    return found


def corpus(rng):
    tests = [sentence(rng, n) for n in (14, 20, 35, 59, 59)] + ["only five words in here", None, ""]
    texts = [sentence(rng, rng.randrange(0, 150)) for _ in range(25)]
    for d, (i, changes) in enumerate([(0, 0), (1, 1), (2, 2), (3, 4), (4, 12), (3, 0)]):
        w = texts[d].split(" ")
        texts[d] = " ".join([*w[:10], edited(rng, tests[i], changes).upper(), *w[10:]])
    part = tests[3].split(" ")
    texts += [" ".join(part[20:45]), " ".join(part[:10]), "so Only five words in here now", None, "", "w1 " * 3000]
    return texts, tests


def test_agrees_with_all_diagonals(spark):
    texts, tests = corpus(random.Random(8))
    rows = C.contaminated(documents(spark, texts), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(texts, tests)
    for r in rows:
        assert len(texts[r.doc_id].encode()[r.start : r.end].decode().split(" ")) == r.n_words


def test_blocks_of_items_agree(spark):
    texts, tests = corpus(random.Random(9))
    whole = C.contaminated(documents(spark, texts), items(spark, tests)).collect()
    parts = C.contaminated(documents(spark, texts), items(spark, tests), block_bytes=200).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, whole))


def test_substitutions_are_found_at_the_tolerance(spark):
    """Thirteen words or more with one in eight replaced: a seed is hit nearly always."""
    rng = random.Random(10)
    tests = [sentence(rng, 40, 10**6) for _ in range(60)]
    rows = C.contaminated(documents(spark, [edited(rng, t, 5) for t in tests]), items(spark, tests)).collect()
    assert len({(r.doc_id, r.item_id) for r in rows if r.doc_id == r.item_id}) >= 57
    assert all(r.doc_id == r.item_id for r in rows)


def test_empty_tables_and_repeated_rows(spark):
    assert C.contaminated(documents(spark, []), items(spark, ["a b"])).collect() == []
    assert C.contaminated(documents(spark, ["a b"]), items(spark, [])).collect() == []
    rows = C.contaminated(documents(spark, ["x a b c d e f g y"] * 2, ids=[4, None]), items(spark, ["a b c d e f g"])).collect()
    assert sorted((str(r.doc_id), r.first_word, r.n_words) for r in rows) == [("4", 1, 7), ("None", 1, 7)]


def by_definition(equal):
    """Whether any stretch of 13 words or more has four equal words in five, by trying all."""
    n = len(equal)
    return any(5 * sum(equal[a:b]) >= 4 * (b - a) for a in range(n) for b in range(a + C.MIN_OVERLAP, n + 1))


def test_each_stretch_at_the_tolerance_counts(spark):
    rng = random.Random(11)
    blocks = [[12, -5, 12], [8, -3, 8], [10, -4, 10], [13, *[-3, 10] * 8], [20, -60, 20], [10, -40, 10]]
    tests = [sentence(rng, sum(map(abs, b)), 10**6) for b in blocks]
    texts = []
    for own, test in zip(blocks, tests, strict=True):
        keep = [n > 0 for n in own for _ in range(abs(n))]
        texts.append(" ".join(w if k else f"x{rng.randrange(10**6)}" for w, k in zip(test.split(" "), keep, strict=True)))
    rows = C.contaminated(documents(spark, texts), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in range(5)}
    assert all(r.n_words >= C.MIN_OVERLAP and 100 * r.n_equal >= C.PERCENT * r.n_words for r in rows)
    assert sorted((r.first_word, r.n_words) for r in rows if r.doc_id == 4) == [(0, 20), (80, 20)]


def test_overlaps_agree_with_the_definition():
    rng = random.Random(12)
    for _ in range(300):
        share = rng.choice((0.5, 0.7, 0.8, 0.9))
        equal = [rng.random() < share for _ in range(rng.randrange(0, 60))]
        doc, item = np.arange(len(equal)), np.where(equal, np.arange(len(equal)), -1)
        found = C.overlaps(doc, np.append(item, [-2] * 13), 0)
        assert bool(found) == by_definition(equal)
        assert all(sum(equal[a : a + n]) == same and 5 * same >= 4 * n and n >= C.MIN_OVERLAP for a, n, same in found)


def test_short_items_are_found_with_all_allowed_substitutions(spark):
    """Every item of 1 to 12 words with as many words replaced as may be; longer ones nine times in ten."""
    rng = random.Random(21)
    tests = [sentence(rng, n, 10**6) for n in range(1, 31) for _ in range(10)]
    texts = []
    for test in tests:
        changes = len(test.split(" ")) * (100 - C.PERCENT) // 100
        texts.append(f"{sentence(rng, 9, 50, 'v')} {edited(rng, test, changes)} {sentence(rng, 9, 50, 'v')}")
    found = {(r.doc_id, r.item_id) for r in C.contaminated(documents(spark, texts), items(spark, tests)).collect()}
    caught = {}
    for i, test in enumerate(tests):
        caught.setdefault(len(test.split(" ")), []).append((i, i) in found)
    assert all(all(hits) for n, hits in caught.items() if n < C.MIN_OVERLAP)
    assert all(sum(hits) >= 0.9 * len(hits) for hits in caught.values())
    worse = [f"a {edited(rng, t, len(t.split(' ')) * (100 - C.PERCENT) // 100 + 1)} b" for t in tests[:120]]
    assert C.contaminated(documents(spark, worse), items(spark, tests)).collect() == []


def test_parts_cover_an_item():
    for size in range(1, 40):
        masks = C.part_masks(size, 80)
        assert len(masks) == size // 5 + 1 and all("1" in m and len(m) == size for m in masks)
        assert all(sum(m[k] == "1" for m in masks) == 1 for k in range(size))
