import glob
import os
import random
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa

from brute import documents, edited, sentence, shingles
from wattframe.llm import passages, staging
from wattframe.llm.words import sets_of


def test_bands_are_tuned():
    bands, rows = passages.tuned_bands(80)
    assert (1 - 0.8**rows) ** bands <= 1e-5 and bands * rows <= 160


def planted(rng):
    """Texts of fresh words; some hold one of two passages of 60 words somewhere in a line."""
    texts = [sentence(rng, 200, 10**6) + "\nshort common line of words.\n" + sentence(rng, 30, 10**6) for _ in range(40)]
    holders = {}
    for p in range(2):
        passage = sentence(rng, 60, 10**6, f"p{p}")
        for d in rng.sample(range(40), 6):
            holders.setdefault(d, []).append(passage)
            w = texts[d].split(" ")
            at = rng.randrange(20, 150)
            texts[d] = " ".join([*w[:at], passage, *w[at:]])
    return texts, holders


def test_passages_inside_lines_are_found_and_others_left(spark):
    texts, holders = planted(random.Random(1))
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert {r.doc_id for r in rows} == set(holders)
    for r in rows:
        part = texts[r.doc_id].encode()[r.start : r.end].decode()
        assert any(part in p for p in holders[r.doc_id]) and len(part.split(" ")) == r.n_words >= passages.MIN_WORDS
    first = {p: min(d for d, own in holders.items() if p in own) for own in holders.values() for p in own}
    cut = {r.doc_id: r.text for r in passages.without_passages(documents(spark, texts), passages.repeated_passages(documents(spark, texts))).collect()}
    for d, own in holders.items():
        for p in own:
            assert (p in cut[d]) == (first[p] == d)
    for d in set(range(40)) - set(holders):
        assert cut[d] == texts[d]


def test_copies_keep_one(spark):
    rng = random.Random(3)
    base = sentence(rng, 120, 10**6)
    texts = [sentence(rng, 50, 10**6), base, base, edited(rng, base, 1), None, "", base]
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    kept = {(r.passage_doc, r.passage_start) for r in rows}
    assert {r.doc_id for r in rows if r.removed} == {2, 3, 6}
    assert {d for d, _ in kept} == {1}


def cut_texts(spark, texts):
    docs = documents(spark, texts)
    return {r.doc_id: r.text for r in passages.without_passages(docs, passages.repeated_passages(docs)).collect()}


def test_nested_runs_keep_one(spark):
    rng = random.Random(5)
    fresh = lambda n: sentence(rng, n, 10**6)
    lead, shared, short, other = fresh(10), fresh(90), fresh(9), fresh(80)
    texts = [f"{fresh(40)}\n{lead}\n{shared}\n{fresh(40)}", f"{fresh(40)}\n{lead}\n{shared}\n{fresh(40)}", f"{fresh(40)}\n{shared}\n{fresh(40)}"]
    texts += [f"{fresh(30)}\n{short}\n{other}\n{fresh(30)}", *[f"{fresh(30)}\n{other}\n{fresh(30)}" for _ in range(2)], f"{fresh(30)}\n{short}\n{fresh(30)}"]
    cut = cut_texts(spark, texts)
    assert [shared in cut[d] for d in range(3)] == [True, False, False]
    assert [other in cut[d] for d in range(3, 6)] == [True, False, False]
    assert all(cut[d] == texts[d] for d in (0, 3, 6))


def test_passages_beside_more_and_less_common_text_are_found(spark):
    rng = random.Random(6)
    fresh = lambda n: sentence(rng, n, 10**6)
    texts, lines = [], []
    for copies in (4, 8, 20):
        line = fresh(60)
        lines.append((line, len(texts)))
        texts += [f"{fresh(120)}\n{line}\n{fresh(120)}"] * copies + [f"{fresh(120)}\n{line}\n{fresh(120)}"]
    common = [fresh(40) for _ in range(4)]
    line = fresh(60)
    lines.append((line, len(texts)))
    texts += [f"{common[0]}\n{line}\n{common[1]}", f"{common[2]}\n{line}\n{common[3]}"]
    texts += [f"{c}\n{fresh(40)}" for c in common for _ in range(6)]
    cut = cut_texts(spark, texts)
    for line, keeper in lines:
        assert [d for d in cut if line in cut[d]] == [keeper]
    for c in common:
        assert sum(c in t for t in cut.values()) == 1


def plain_runs(first, last, count, mark, min_words):
    found = set()
    for a in range(len(first)):
        for b in range(a, len(first)):
            if b > a and first[b] >= last[b - 1]:
                break
            low = min(count[a : b + 1])
            left = a and first[a] < last[a - 1]
            right = b + 1 < len(first) and first[b + 1] < last[b]
            level = not (left and count[a - 1] >= low) and not (right and count[b + 1] >= low)
            kinds = set(zip(count[a : b + 1], mark[a : b + 1], strict=True))
            alike = len(kinds) == 1 and not (left and (count[a - 1], mark[a - 1]) in kinds) and not (right and (count[b + 1], mark[b + 1]) in kinds)
            if (level or alike) and last[b] - first[a] >= min_words:
                found.add((first[a], last[b]))
    return found


def test_runs_agree_with_all_stretches():
    rng = random.Random(7)
    for _ in range(300):
        cuts = [0]
        for _ in range(rng.randrange(2, 25)):
            cuts.append(cuts[-1] + rng.randrange(1, 12))
        at = [i for i in range(len(cuts) - 2) if rng.random() < 0.9]
        first, last = [cuts[i] for i in at], [cuts[i + 2] for i in at]
        count, mark = [rng.choice((2, 2, 3, 5)) for _ in at], [rng.randrange(2) for _ in at]
        plain = plain_runs(first, last, count, mark, 20)
        args = [np.array(x, np.int64) for x in (first, last, count, mark)]
        assert set(passages.runs(*args, 20, 100)) == plain
        some = set(passages.runs(*args, 20))
        assert some <= plain
        for a, b in plain - some:
            assert any(x <= a and b <= y and (b - a - 4) * 180 >= 160 * (y - x - 4) for x, y in some)


def test_edge_cases(spark):
    assert passages.repeated_passages(documents(spark, [])).collect() == []
    rng = random.Random(4)
    docs = documents(spark, [None, "", sentence(rng, 90, 10**6)] * 2, ids=[1, 2, 3, 1, 2, 3])
    assert passages.repeated_passages(docs).collect() == []  # one document, not two
    assert passages.without_passages(docs, passages.repeated_passages(docs)).count() == 6


def test_cuts():
    assert passages.without_spans(b"abcdefgh", [(4, 6), (1, 3), (2, 5)]) == b"agh"
    assert passages.without_spans(b"", []) == b""


def linked(rows, first, second):
    """Whether places (doc_id, text holding the passage's first words) are one component's."""
    place = {(r.doc_id, r.start): (r.passage_doc, r.passage_start) for r in rows}
    return first in place and place.get(first) == place.get(second)


def test_near_equal_lines_and_blocks_are_linked_as_by_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        line = sentence(rng, rng.randrange(20, 70), 10**6)
        other = edited(rng, line, rng.randrange(1, 3)) if rng.random() < 0.5 else line.rsplit(" ", rng.randrange(1, 4))[0]
        texts += [f"{sentence(rng, 12, 10**6)}\n{x}\n{sentence(rng, 12, 10**6)}" for x in (line, other)]
    block = [sentence(rng, 12, 10**6) for _ in range(8)]
    texts += ["\n".join([sentence(rng, 9, 10**6), "", *x, " ", sentence(rng, 9, 10**6)]) for x in (block, [*block[:5], "one line more", *block[5:]])]
    found = passages.repeated_passages(documents(spark, texts)).collect()
    near = 0
    for a in range(0, len(texts), 2):
        one, two = (texts[i].split("\n", 2)[1:2] if a < 80 else [texts[i].split("\n\n")[1].rsplit("\n \n", 1)[0]] for i in (a, a + 1))
        at = [texts[i].index(x) for i, x in ((a, one[0]), (a + 1, two[0]))]
        left, right = shingles(one[0], 5), shingles(two[0], 5)
        meets = 100 * len(left & right) >= 80 * len(left | right) and min(len(x[0].split()) for x in (one, two)) >= 20
        near += meets
        assert not meets or linked(found, (a, at[0]), (a + 1, at[1])), (a, one, two)
    assert near > 20


def test_prefixes_leave_out_no_pair():
    rng = random.Random(10)
    lines = []
    for _ in range(200):
        base = sentence(rng, rng.randrange(20, 90), 10**6)
        lines += [base, edited(rng, base, rng.randrange(1, 4))]
    words = passages.words_of(pa.array(["\n".join(lines)]))
    first, last = passages.stretches(words, 20)
    assert len(first) == 400
    keys, owner = passages.prefixes(words, first, last, 80)
    sets = [set(keys[owner == i].tolist()) for i in range(400)]
    for i in range(0, 400, 2):
        left, right = shingles(lines[i], 5), shingles(lines[i + 1], 5)
        assert 100 * len(left & right) < 80 * len(left | right) or sets[i] & sets[i + 1]
    assert sum(map(len, sets)) < 0.4 * sum(len(shingles(x, 5)) for x in lines)


def test_passages_that_repeat_in_one_text_and_in_texts_of_one_id(spark):
    rng = random.Random(11)
    fresh = lambda n: sentence(rng, n, 10**6)
    line, passage = fresh(40), fresh(60)
    texts = [f"{fresh(30)}\n{line}\n{fresh(30)}\n{line}\n{fresh(30)}", f"{fresh(40)} {passage} {fresh(40)}", f"{fresh(70)} {passage} {fresh(20)}"]
    docs = documents(spark, texts, ids=[1, 2, 2])
    found = passages.repeated_passages(docs)
    cut = sorted((r.doc_id, r.text) for r in passages.without_passages(docs, found).collect())
    assert cut[0][1].count(line) == 1 and len(cut[0][1]) == len(texts[0]) - len(line)
    assert sorted(passage in t for d, t in cut if d == 2) == [False, True]
    assert all(any(t.startswith(x[:60]) and t.endswith(x[-60:]) for x in texts[1:]) for d, t in cut if d == 2)


def test_runs_are_left_out_by_their_sets():
    shingles_ = np.array([*[1, 2, 3, 4] * 25, *range(10, 22)], np.uint64)  # 100 of four kinds, then 12 of their own
    spans = [(0, 116), (0, 104)]
    assert passages.candidates(spans, [], shingles_, 80) == [(0, 104), (0, 116)]
    assert passages.candidates(spans, [(3, 30)], np.arange(112, dtype=np.uint64), 80) == [(0, 116), (3, 30)]


def test_what_is_read_no_more_leaves_the_disk(spark, monkeypatch, folder):
    """Only small tables stay for the result, no sets of paragraphs and no shuffle files."""
    monkeypatch.setattr(staging, "shared_folder", lambda _, purpose: f"{folder}/{purpose}-{uuid.uuid4().hex}")
    blocks = f"{os.environ.get('SPARK_LOCAL_DIRS', tempfile.gettempdir())}/blockmgr-*/*/shuffle_*.data"
    old = set(glob.glob(blocks))
    found = passages.repeated_passages(documents(spark, planted(random.Random(4))[0]))
    left = {x.rsplit("-", 1)[0] for x in os.listdir(folder)}
    assert {"merged", "kept"} <= left
    assert not left & {"units", "met", "counted", "runs", "paragraphs", "classes", "places", "bands", "sets", "placed"}
    end = time.time() + 20  # Spark removes them in the background
    while (rest := set(glob.glob(blocks)) - old) and time.time() < end:
        time.sleep(0.2)
    assert not rest
    assert found.count() > 0


def test_sets_are_sorted_and_distinct():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 50):
        bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 6, n)))).astype(np.int64)
        hashes = rng.integers(0, 4, bounds[-1]).astype(np.uint64)
        expected = [np.unique(hashes[a:b]).tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        sets, ends = sets_of(hashes, bounds)
        assert [sets[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == expected
