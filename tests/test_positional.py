import itertools
import math
import random

import numpy as np
import pytest

from lexloom.operators import index, positional, search

DOCS, QUERIES = "doc_id long, tokens array<string>", "query_id long, tokens array<string>"


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    docs = [(i, rng.choices(words, k=rng.choice((0, 1, 5, 60)))) for i in range(60)] + [(100, ["a"] * 12), (101, None)]
    queries = [(i, rng.choices(words, k=rng.choice((1, 1, 2, 3)))) for i in range(20)] + [(50, ["a", "a"]), (51, []), (52, ["w1", "unknown"]), (53, docs[3][1] or ["w0"])]
    return docs, queries


@pytest.mark.parametrize("seed", range(3))
def test_phrases_against_every_start(spark, seed):
    docs, queries = corpus(seed)
    ix = positional.postings(spark.createDataFrame(docs, DOCS))
    got = {(r["query_id"], r["doc_id"]): (r["n"], r["first"]) for r in positional.phrases(spark.createDataFrame(queries, QUERIES), ix).collect()}
    want = {}
    for q, qt in queries:
        for d, dt in docs:
            starts = [i for i in range(len(dt or ()) - len(qt) + 1) if qt and dt[i : i + len(qt)] == qt]
            if starts:
                want[q, d] = (len(starts), starts[0])
    assert got == want


def test_postings(spark):
    ix = positional.postings(spark.createDataFrame([(1, ["b", "a", "b"]), (2, None), (3, ["a"])], DOCS))
    assert {(r["token"], r["doc_id"]): (r["f"], r["positions"]) for r in ix.collect()} == {("a", 1): (1, [1]), ("b", 1): (2, [0, 2]), ("a", 3): (1, [0])}


def test_shortest_stretch():
    rng = random.Random(1)
    for _ in range(300):
        pool = rng.sample(range(30), rng.randint(1, 12))
        lists = [sorted(rng.sample(pool, rng.randint(1, len(pool)))) for _ in range(rng.randint(1, 4))]
        want = min(max(c) - min(c) + 1 for c in itertools.product(*lists))
        assert positional.shortest([np.array(x) for x in lists]) == want


def test_proximity_moves_near_words_up(spark):
    filler = [f"f{i}" for i in range(20)]
    docs = [(1, ["x", *filler, "y"]), (2, ["x", "y", *filler]), (3, ["x", *filler, "z"]), (4, ["z"] * 4)]
    frame = spark.createDataFrame(docs, DOCS)
    q = spark.createDataFrame([(1, ["x", "y"])], QUERIES)
    ix, pos = index.build(frame), positional.postings(frame)
    best = search.bm25(q, ix, 3)
    near = {r["doc_id"]: (r["matched"], r["span"]) for r in positional.spans(best, q, pos).collect()}
    assert near == {1: (2, 22), 2: (2, 2), 3: (1, 1)}
    got = positional.proximity_rerank(best, q, pos, 3).orderBy("rank").collect()
    score = {r["doc_id"]: r["score"] for r in best.collect()}
    assert got[0]["doc_id"] == 2 and all(r["score"] == pytest.approx(score[r["doc_id"]] + math.log(0.3 + math.exp(-near[r["doc_id"]][1] / near[r["doc_id"]][0])), abs=2e-6) for r in got)


def test_candidate_without_a_token(spark):
    frame = spark.createDataFrame([(1, ["x"])], DOCS)
    q, best = spark.createDataFrame([(1, ["x"])], QUERIES), spark.createDataFrame([(1, 7, 2.0), (1, 1, 2.0)], "query_id long, doc_id long, score double")
    got = {r["doc_id"]: r["score"] for r in positional.proximity_rerank(best, q, positional.postings(frame), 5).collect()}
    assert got[7] == pytest.approx(2 + math.log(0.3), abs=1e-6) and got[1] > got[7]


def test_empty(spark):
    docs, queries = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, ["a"])], QUERIES)
    assert positional.phrases(queries, positional.postings(docs)).count() == 0
