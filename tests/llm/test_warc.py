import base64
import gzip
import hashlib
import io
import json

import pytest

from lexloom.llm import warc
from lexloom.storage import fresh_path

SCHEMA = "page_id long, url string, html string, payload string, refers_to string"


def brute(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        p = (html or "").encode()
        if page_id is not None:
            first[p] = min(first.get(p, page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        p = (html or "").encode()
        f = first.get(p)
        revisit = f is not None and page_id != f
        out.append((page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (3, "http://a/é\r\nX: y", "same", "p", "q"), (1, None, "same", "p", "q"), (2, "u", None, "p", "q"), (4, "u", "", "p", "q"), (5, "u", "é" * 100_000, "p", "q"),
    (6, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "p", "q"), (7, "u", "x", "p", "q"), (7, "u", "x", "p", "q"), (None, "u", "lone", "p", "q"), (None, "u", "same", "p", "q"),
]


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip(spark):
    df = warc.round_trip(spark, spark.createDataFrame(ROWS, SCHEMA))
    assert result(df) == brute(ROWS)
    texts = {r.page_id: r.payload for r in df.collect() if r.record_type == "response"}
    assert bytes(texts[6]).decode() == ROWS[5][2] and bytes(texts[5]).decode() == ROWS[4][2]
    assert {r.url for r in df.collect() if r.page_id == 1} == {None}


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert result(warc.query(spark, "/root/testdata/sf0.01")) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


@pytest.mark.parametrize("members", [False, True])
def test_normaliser(tmp_path, members):
    """One gzip stream, or one of several members: every record becomes a member, found by the index."""
    data = [warc.record(i, "u", bytes([i % 256]) * (i * 997), warc.digest(b"")) for i in range(40)]
    raw = b"".join(map(gzip.compress, data)) if members else gzip.compress(b"".join(data))
    (tmp_path / "raw.warc.gz").write_bytes(raw)
    index = warc.normalise(f"file://{tmp_path}/raw.warc.gz", f"file://{tmp_path}/out.warc.gz")
    out = (tmp_path / "out.warc.gz").read_bytes()
    lines = [json.loads(x) for x in (tmp_path / "out.warc.gz.idx").read_text().splitlines()]
    assert index == len(lines) == 40 and gzip.decompress(out) == b"".join(data)
    for (at, n, rid), want in zip(((x["offset"], x["length"], x["id"]) for x in lines), data):
        assert gzip.decompress(out[at : at + n]) == want and rid in want.decode("latin-1")
    assert len((tmp_path / "out.warc.gz.idx").read_text().splitlines()) == 40


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_records_of_any_chunking(size):
    data = [warc.record(i, None, b"x" * i, warc.digest(b"")) for i in range(30)]
    raw = io.BytesIO(gzip.compress(b"".join(data)))
    assert list(warc.records_of(iter(lambda: raw.read(size), b""))) == data


def test_truncated_archives_fail():
    raw = gzip.compress(warc.record(1, None, b"abc" * 1000, warc.digest(b"")) * 3)
    with pytest.raises(ValueError):
        list(warc.records_of([raw[: len(raw) // 2]]))


def test_several_archives_in_a_partition(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    folder = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, "u", "t" * 900 + str(i), "", "") for i in range(12)], SCHEMA).coalesce(1)
    archives = warc.write(warc.with_revisits(pages), folder + "/raw")
    assert archives.count() == 6  # two records of 900 characters and their heads reach the limit
    filesystem, path = warc.filesystem(folder + "/warc")
    filesystem.create_dir(path, recursive=True)
    done = warc.normalise_all(archives, folder + "/warc")
    assert sorted(r.records for r in done.collect()) == [2] * 6
    assert sorted(r.page_id for r in warc.read(warc.index_of(done)).collect()) == list(range(12))


def test_records_are_read_by_the_sidecar(spark):
    """A sidecar without its first line hides that record: the offsets come from nowhere else."""
    folder = fresh_path(spark, "warc-idx")
    pages = spark.createDataFrame([(i, "u", f"text {i}", "", "") for i in range(5)], SCHEMA).coalesce(1)
    archives = warc.write(warc.with_revisits(pages), folder + "/raw")
    filesystem, path = warc.filesystem(folder + "/warc")
    filesystem.create_dir(path, recursive=True)
    done = warc.normalise_all(archives, folder + "/warc")
    fs, idx = warc.filesystem(done.first().archive + ".idx")
    lines = fs.open_input_stream(idx).read().splitlines(keepends=True)
    with fs.open_output_stream(idx) as f:
        f.write(b"".join(lines[1:]))
    got = {r.page_id for r in warc.read(warc.index_of(done)).collect()}
    assert len(lines) == 5 and len(got) == 4


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "mine", 7), (2, "u", "ab", "mine", 7)], "page_id long, url string, html string, payload string, __sha int")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(spark, pages).collect()} == {(1, None), (2, 1)}


def test_least_payload(spark):
    rows = [(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcd", "", ""), (4, "u", "abcd", "", "")]
    got = {r.page_id: r.refers_to for r in warc.with_revisits(spark.createDataFrame(rows, SCHEMA), least=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
