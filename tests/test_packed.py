"""Indexes of texts: words found, counted and summed in Arrow batches equal those of columns and joins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions import words as W
from lexloom.operators import index, search, tokenmap, vector

ODD = [
    None, "", " ", "_", "__ _ _a_", "the THE and", "Ünïcode straße ΑΣ ΟΔΟΣ, naïve", "a1 2b ٣٤ Ⅷ ²½", "漢字かな 한국어", "x́y é", "𝒜𝒷 𐐀𐐨 😀smile😀", "don't I'll they're",
    "İstanbul ǅ ﬁ", "tab\tnew\nline\r\nnul\x00byte", " nbsp em﻿", "-" * 50, "longword" * 500, "end_", "‍zwj‍", "ᴬ ᾼ ⓐ 〇 ꙮ", "\U0003ffff \U0010ffff ퟿  z",
]


def texts(spark, n=400, seed=3):
    rng = random.Random(seed)
    words = ["fox", "Red", "the", "größe", "naïve", "w1", "_", "漢字"] + [f"t{i}" for i in range(60)]
    docs = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choices(words, k=rng.randint(0, 30)) + [f"only{i}"] * (i % 3))) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def joined(spark, docs):
    return index.build(docs.select("doc_id", T.terms(F.col("text")).alias("tokens")))


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_an_index_of_texts_is_that_of_their_tokens(spark, batch, monkeypatch):
    monkeypatch.setattr(index, "HELD_WORDS", 50)
    docs = texts(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found, want = index.build_texts(docs), joined(spark, docs)
        assert found.packed is not None and (found.n, found.avgdl) == (want.n, want.avgdl) and abs(found.avg_idf - want.avg_idf) < 1e-9
        assert rows(found.tf) == rows(want.tf) and rows(found.dl) == rows(want.dl)
        assert {r.token: r.n_t for r in found.idf.collect()} == {r.token: r.n_t for r in want.idf.collect()}
        assert {r.doc_id: dict(zip(r.tokens, r.f)) for r in found.forward.collect()} == {r.doc_id: dict(zip(r.tokens, r.f)) for r in want.forward.collect()}
        asked = spark.createDataFrame([(0, ["fox", "größe", "only7", "none"]), (1, ["漢字", "t1", "t1"]), (2, [])], "query_id long, tokens array<string>")
        assert rows(search.bm25(asked, found, 7)) == rows(search.bm25(asked, want, 7)) and rows(search.overlap(asked, found)) == rows(search.overlap(asked, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_code_point_belongs_to_tokens_as_in_columns(spark):
    points = W.word_points(spark)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    text = ["".join(f"{c} " for c in every[i : i + 5000]) for i in range(0, len(every), 5000)]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(text)), "i long, text string").orderBy("i").select(T.tokens(F.col("text"))).collect()]
    got = W.tokens_of(pa.array([r[0] for r in spark.createDataFrame(list(enumerate(text)), "i long, text string").orderBy("i").select(F.lower("text")).collect()]), points)
    assert got.to_pylist() == want


def test_packed_rows_come_back():
    lists = [["a", "bb"], [], ["漢"], [], ["x", "y", "z"], []]
    kinds, at, ends = pa.array(["a", "bb", "漢", "x", "y", "z"]), np.arange(6), np.array([0, 2, 2, 3, 3, 6, 6])
    assert W.unpacked(W.packed(ends, kinds, at)).to_pylist() == lists
    assert W.unpacked(W.packed(ends, kinds, at).slice(2, 3)).to_pylist() == lists[2:5]
    assert W.unpacked(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("n", [1, 2, 5, 300, 5000])
def test_a_token_map_has_every_number(spark, n, monkeypatch):
    monkeypatch.setattr(tokenmap, "BUCKET", 64)
    rng = random.Random(n)
    numbers = {f"w{i}" * rng.randint(1, 4): rng.randrange(1 << 32) for i in range(n)}
    known = tokenmap.TokenMap.build(spark.createDataFrame(list(numbers.items()), "token string, number long").repartition(3), n)
    assert known.number(pa.array(list(numbers))).tolist() == list(numbers.values())


def test_equal_hashes_give_no_map(spark, monkeypatch):
    numbers = spark.createDataFrame([("a", 1), ("a", 2)], "token string, number long")
    assert tokenmap.TokenMap.build(numbers, 2) is None


@pytest.mark.parametrize("mapped", [0, 1 << 24])
def test_vectors_of_texts_are_summed_without_joins(spark, mapped, monkeypatch):
    monkeypatch.setattr(vector, "MAPPED", mapped)
    docs = texts(spark)
    found, want = index.build_texts(docs), joined(spark, docs)
    for power in (1, 2):
        sums = vector.index_sums(found, 8, power)
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert not mapped or "Exchange" not in plan and "Join" not in plan
        got = {r.doc_id: (r.norm, [(e.slot, e.w) for e in r.slots]) for r in sums.collect()}
        old = {r.doc_id: (r.norm, sorted((e.slot, e.w) for e in r.slots)) for r in vector.slot_sums(want.tf, want.idf, "doc_id", 8, power).collect()}
        assert got.keys() == old.keys()
        for d, (norm, slots) in old.items():
            assert abs(got[d][0] - norm) < 1e-9 and [s for s, _ in got[d][1]] == [s for s, _ in slots]
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[d][1], slots))
    got, old = ({r.doc_id: r.embedding for r in vector.embed_index(ix, 8).collect()} for ix in (found, want))
    assert got.keys() == old.keys() and all(got[d] is None if old[d] is None else np.allclose(got[d], old[d]) for d in old)


def test_texts_of_repeated_ids_are_merged(spark):
    ix = index.build_texts(spark.createDataFrame([(1, "a b c red"), (1, "a red fox"), (2, "red")], "doc_id long, text string"))
    assert ix.packed is None and {(r.token, r.doc_id, r.f) for r in ix.tf.collect()} >= {("red", 1, 1), ("fox", 1, 1), ("red", 2, 1)}


def test_answers_read_packed_rows(spark):
    """rag_answer and hybrid_search make their lists from packed rows; vectors meet no tokens by joins."""
    from lexloom.plans import catalog

    ix = catalog.built(spark, "/root/testdata/sf0.001")
    assert ix.packed is not None and ix.rows is ix.packed
    plan = vector.embed_index(ix, catalog.DIM)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
