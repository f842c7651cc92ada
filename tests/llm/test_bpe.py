import hashlib
import random

import numpy as np
import pytest

from lexloom.llm import bpe


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers
    import tiktoken

    c = bpe.codec(bpe.default_path())
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def ids(c, text):
    return np.frombuffer(c.encode(text), "<u4").tolist()


def test_every_code_point(tools):
    c, enc = tools
    for cp in [*range(0xD800), *range(0xE000, 0x110000, 3)]:
        s = f"a{chr(cp)}1"
        assert ids(c, s) == enc.encode_ordinary(s), hex(cp)


def test_random_texts(tools):
    c, enc = tools
    rng = random.Random(3)
    pool = [chr(i) for i in [*range(0x20, 0x250), *range(0x1C, 0x20), *range(0x2000, 0x2070), *range(0x4E00, 0x4E20), 0x1F600, 0x85, 0x3000]]
    for _ in range(3000):
        s = "".join(rng.choice(pool if rng.random() < 0.5 else "the ing 's'll  \n\t12ab") for _ in range(rng.randint(0, 60)))
        assert ids(c, s) == enc.encode_ordinary(s)
        assert c.decode(c.encode(s)) == s.encode()


def test_compatibility_agrees_with_plain_merging(tools):
    c, _ = tools
    rng = random.Random(5)
    ranks = sorted(c.ranks.values())
    for _ in range(20_000):
        a, b = rng.choice(ranks), rng.choice(ranks[:2000])
        assert c.compatible(a, b) == (c._merge(c.tokens[a] + c.tokens[b], 1 << 62) == (a, b))


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 50_000, " " * 9000, "é" * 20_000, "<|endoftext|>"])
def test_long_pieces_round_trip(tools, text):
    c, enc = tools
    assert c.decode(c.encode(text)) == text.encode()
    if len(text) < 10_000:
        assert ids(c, text) == enc.encode_ordinary(text)


def test_caches_start_again(tools):
    c, enc = bpe.Codec(bpe.default_path(), cache=10), tools[1]
    for i in range(200):
        s = f"word{i} other{i * 7}"
        assert ids(c, s) == enc.encode_ordinary(s)
        assert len(c.pieces) + len(c.pieces.old) <= 10 and len(c.fits) <= 10


def test_tables(spark, tools):
    c, _ = tools
    docs = spark.createDataFrame([(1, None, "x", 5), (2, "", "x", 5), (3, "héllo\nwörld", None, 5), (3, "héllo\nwörld", None, 5), (None, "x", "y", 5)], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.digests(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[:2]] == [(1, 0, empty, empty), (2, 0, empty, empty)]
    assert got[2].decoded_sha256 == hashlib.sha256("héllo\nwörld".encode()).hexdigest() and got[2] == got[3]
    rows = bpe.tokenize(docs).collect()
    assert all(r.round_trip for r in rows) and [r.n_tokens for r in rows] == [r.n_tokens for r in got]
    assert bytes(rows[2].ids) == c.encode("héllo\nwörld")
    empty_table = spark.createDataFrame([], docs.schema)
    assert bpe.digests(empty_table).count() == 0 and bpe.tokenize(empty_table).count() == 0


def test_whole_table(spark, tools):
    _, enc = tools
    d = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.query(spark, "/root/testdata/sf0.001").collect():
        want = enc.encode_ordinary(d[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d[r.doc_id].encode()).hexdigest()
