import hashlib
import io

import pytest
import zstandard
from pyspark.sql import types as T

from wattframe.llm import warc as W
from wattframe.tables import local_table

PAGES = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("payload", T.StringType()), ("sha1", T.StringType()))])


def table(spark, rows):
    return local_table(spark, [(*r, "p", "s") for r in rows], PAGES)


def sample():
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://c/", big), (3, "u\r\nx", None), (4, "u", ""), (5, "u", "short")]
    rows += [(6, "u", "short"), (7, "u", other), (8, "u", other), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "\r\n\r\n" * 300)]
    return rows + [(20 + i, f"http://h/{i}", f"page {i} " * (i * 7)) for i in range(60)] + [(100, "u", "long " * 300_000)]


def expected(rows):
    best = {}
    for i, _, h in rows:
        best[h] = max(best.get(h, i), i)
    out = {}
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and best[h] != i
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[h] if again else None)
    return out


@pytest.fixture
def archive(spark, folder):
    path = f"{folder}/warc"
    W.write_archives(table(spark, sample()), path, frame_bytes=3000, bundle_bytes=4000)
    return path


def test_round_trip(spark, archive):
    rows = W.read_archives(spark, archive).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(sample())
    texts = {i: (h or "").encode() for i, _, h in sample()}
    assert all(bytes(r.payload) == texts[r.page_id] for r in rows if r.record_type == "response")
    assert len(rows) == len(sample())


def test_files_are_plain_zstandard_with_a_seek_table(spark, archive):
    files = W.archive_files(spark, archive).collect()
    assert len(files) > 3
    for f in files:
        data = bytes(f.content)
        assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")
        frames = W.seek_table(data)
        assert frames[-1][2] == 0 and data[frames[-1][0] :][:4] == W.SKIPPABLE.to_bytes(4, "little")
        whole = b"".join(W.frame_of(data, frames, n) for n in range(len(frames) - 1))
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
        assert reader.read() == whole and whole.startswith(b"WARC/1.1\r\n")


def test_index_finds_each_record_in_one_frame(spark, archive):
    files = {f.path: bytes(f.content) for f in W.archive_files(spark, archive).collect()}
    index = W.archive_index(spark, archive).collect()
    assert len({r.record_id for r in index}) == len(index) == len(sample())
    for r in index:
        data = files[r.path]
        part = W.frame_of(data, W.seek_table(data), r.frame)[r.offset : r.offset + r.size]
        assert W.parsed(part)[0]["WARC-Record-ID"] == r.record_id


def test_edge_cases(spark, folder):
    W.write_archives(table(spark, []), f"{folder}/none")
    assert W.read_archives(spark, f"{folder}/none").count() == 0
    W.write_archives(table(spark, [(None, None, None), (1, "u", "z" * 2000), (1, "u", "z" * 2000), (None, "u", "z" * 2000)]), f"{folder}/odd")
    rows = W.read_archives(spark, f"{folder}/odd").collect()
    assert sorted((str(r.page_id), r.record_type) for r in rows) == [("1", "response")] * 2 + [("None", "response")] * 2


def test_damage_is_noticed(spark, folder):
    with pytest.raises(ValueError):
        W.seek_table(b"not a bundle")
