"""Plain Python versions of what the operators must give, and small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import types as T

from wattframe.tables import local_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),  # clashes with results
        T.StructField("kept", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def documents(spark, texts, langs=None, sources=None, ids=None):
    """A documents table with extra columns whose names clash with results."""
    rows = [
        (
            i if ids is None else ids[i],
            t,
            None if langs is None else langs[i],
            None if sources is None else sources[i],
            len(t or ""),
            "s",
            "k",
            "b",
        )
        for i, t in enumerate(texts)
    ]
    return local_table(spark, rows, DOCS)


def sentence(rng, n, vocabulary=400, mark="w"):
    return " ".join(f"{mark}{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, changes):
    out = text.split(" ")
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(n)], strict=False))


def groups(ids, sets, percent=80):
    """Smallest id reachable over links between sets, by comparing all pairs."""
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(ids[a]), top(ids[b])))
                parent[y] = x
    return {i: top(i) for i in ids}


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(inside),
        len(w) < 20 or 100 * len(inside) > 30 * len(w),
    )


def unigram(texts, held_out):
    """n_tokens, n_known, N and base score of each text."""
    tokens = [[*words(t), None] for t in texts]
    counts = Counter(x for t, h in zip(tokens, held_out, strict=True) if not h for x in t)
    total = sum(counts.values())
    norm = math.log10(total + 0.1 * (len(counts) + 1))
    return [
        (len(t), sum(x in counts for x in t), total, sum(math.log10(counts[x] + 0.1) - norm for x in t))
        for t in tokens
    ]


def shuffled(items, seed=3):
    out = list(items)
    random.Random(seed).shuffle(out)
    return out
