import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from brute import documents, edited, sentence
from wattframe.llm import suffixes as S
from wattframe.tables import local_table


def brute(texts, width):
    """What repeated_bytes must give, by counting every string of the width."""
    texts = [(t or "").encode() for t in texts]
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def found(df):
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    for r in rows:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
    return [(r.n_bytes, len(r.spans), bytes(r.kept)) for r in rows]


def corpus(rng):
    texts = [sentence(rng, rng.randrange(0, 120)) for _ in range(20)]
    shared = sentence(rng, 60)
    for i in range(0, 12, 2):
        w = texts[i].split(" ")
        texts[i] = " ".join([*w[:7], shared if i % 4 else edited(rng, shared, 1), *w[7:]])
    texts += [texts[0], texts[0], edited(rng, texts[3] + shared, 2), "é" * 90 + shared[:150], "x" * 700, "xy" * 400]
    texts += [shared[:199], shared[:200], shared[:201], None, "", "short", "a\x00b" * 120, "the same line\n" * 40]
    return texts


def test_order_is_that_of_all_suffixes():
    rng = random.Random(3)
    for _ in range(120):
        letters = rng.choice([1, 2, 3, 200])
        data = bytes(rng.randrange(letters) for _ in range(rng.randrange(120)))
        data += data[: rng.randrange(40)]
        array = np.frombuffer(data, np.uint8)
        order = sorted(range(len(data)), key=lambda i: data[i:])
        assert S.suffix_order(array, 400).tolist() == order
        assert S.smaller_than_next(array).tolist() == [data[i:] < data[i + 1 :] for i in range(len(data))]
        wanted = np.array([rng.random() < 0.3 for _ in data], bool)
        assert S.suffix_order(array, 400, wanted).tolist() == [i for i in order if wanted[i]]
        common = S.common_prefixes(array, np.array(order, np.int64), 50)
        for k in range(1, len(order)):
            a, b = data[order[k - 1] :], data[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == min(same, 50)


def test_every_start_is_in_one_stretch_of_its_own_anchor(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 700)
    rng = random.Random(4)
    texts = [sentence(rng, n).encode() for n in (300, 1, 60, 0, 90)] + [b"ab" * 300, b"z" * 900]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    rows = S.stretches(data, offsets, 60, 15)
    starts, anchors = [], {}
    for text, first, last, anchor in zip(rows["text"], rows["first"], rows["last"], rows["anchor"]):
        for i in range(first, last + 1):
            starts.append((text, i))
            assert anchors.setdefault(texts[text][i : i + 60], anchor) == anchor
    assert sorted(starts) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 59)]
    assert len(rows["first"]) < len(starts) / 8


def test_agrees_with_brute_force(spark):
    texts = corpus(random.Random(5))
    docs = documents(spark, texts)
    assert found(S.repeated_bytes(docs)) == brute(texts, 200)
    assert found(S.repeated_bytes(docs.repartition(7), width=40)) == brute(texts, 40)


def test_crowded_anchors_are_compared_by_digest(spark):
    texts = corpus(random.Random(6))
    assert found(S.repeated_bytes(documents(spark, texts), width=60, crowded=1)) == brute(texts, 60)


def test_small_sort_batches_and_blocks(spark, monkeypatch):
    rng = random.Random(7)
    long = sentence(rng, 9000)
    texts = [long, "front " + long[5000:30000] + " end", long[200:700]]
    assert found(S.repeated_bytes(documents(spark, texts))) == brute(texts, 200)


def test_ids_and_empty_tables(spark):
    rng = random.Random(8)
    text = sentence(rng, 80)
    docs = documents(spark, [text, text, sentence(rng, 80)], ids=[None, 5, 5])
    rows = S.repeated_bytes(docs).collect()
    assert sorted((r.doc_id or 0, len(r.kept) == 0) for r in rows) == [(0, True), (5, False), (5, True)]
    assert S.repeated_bytes(docs.limit(0)).collect() == []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.LongType())])
    odd = local_table(spark, [(1, text, 3), (2, None, 4)], schema)
    assert [r.n_bytes for r in S.repeated_bytes(odd).orderBy("doc_id").collect()] == [len(text), 0]


def test_query_columns(spark):
    rows = S.op12_suffix_array_dedup(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = brute([d.text for d in docs], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}
    assert got == {
        d.doc_id: (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for d, (n, spans, kept) in zip(docs, want)
    }
