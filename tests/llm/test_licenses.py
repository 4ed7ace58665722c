import hashlib

from pyspark.sql import functions as F

from brute import documents
from wattframe.llm import licenses as L

MIT = L.KNOWN[0][1]


def scan(spark, texts, known=None, **more):
    rows = L.scanned(documents(spark, texts), spark.createDataFrame(L.KNOWN if known is None else known, L.KNOWN_SCHEMA), **more)
    return {r.doc_id: r for r in rows.collect()}


def test_variants_of_a_text_have_one_digest(spark):
    texts = [
        MIT,
        "Copyright (c) 2019 Someone\n\n" + MIT.upper(),
        "© 2001-2020, A. Nother\n" + MIT.replace(",", " ;").replace('"', "“"),
        MIT.replace("sublicense", "sub-licence"),
        MIT.replace("free of charge", "for a fee"),
    ]
    rows = scan(spark, texts)
    assert [rows[i].license for i in range(5)] == ["MIT"] * 4 + [None]
    assert len({rows[i].digest for i in range(4)}) == 1


def test_every_known_text_is_found(spark):
    rows = scan(spark, [t for _, t in L.KNOWN])
    assert [rows[i].license for i in range(len(L.KNOWN))] == [n for n, _ in L.KNOWN]


def test_notices_are_whole_lines(spark):
    texts = ["some text\nReleased under the MIT licence!\nmore\nLICENSED UNDER CC BY-NC 4.0", "we released under the MIT License. it", "all rights reserved"]
    for limit in (1000, 2):
        rows = scan(spark, texts, broadcast_licenses=limit)
        assert [rows[i].notices for i in range(3)] == [["CC-BY-NC-4.0", "MIT"], [], ["reserved"]]
        assert rows[2].license == "reserved"


def test_canonical_form(spark):
    row = spark.range(1).select(L.canonical(F.lit("Copyright 2020 X\n  The LICENCE:\tNon-Commercial & more \n\n©\nok")).alias("c")).first()
    assert row.c == "the license noncommercial and more ok"


def test_edge_cases(spark):
    rows = scan(spark, [None, "", " \n\t", "Copyright (c) 2020 by me", "x", "x"])
    assert [rows[i].digest for i in range(4)] == [None] * 4
    assert rows[4].digest == rows[5].digest == hashlib.sha256(b"x").hexdigest() and rows[4].notices == []
    assert scan(spark, []) == {}
    assert scan(spark, ["x"], known=[])[0].license is None
    twice = L.scanned(documents(spark, ["a\nAll rights reserved."] * 2, ids=[1, 1]), spark.createDataFrame(L.KNOWN, L.KNOWN_SCHEMA))
    assert [r.notices for r in twice.collect()] == [["reserved"]] * 2
