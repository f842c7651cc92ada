import random

import pytest

from lexloom.operators import blockmax, index, search


def corpus(spark, n, seed, common=40):
    """Documents of common words, some with rare ones; queries of both kinds."""
    rng = random.Random(seed)
    words = [f"c{i}" for i in range(common)]
    docs = []
    for i in range(n):
        toks = rng.choices(words, weights=[1 / (j + 1) for j in range(common)], k=rng.randint(0, 40))
        if rng.random() < 0.05:
            toks += [f"r{rng.randrange(30)}"] * rng.randint(1, 3)
        docs.append((i, toks))
    queries = [(0, ["r1", "c0", "c1"]), (1, ["c0", "c0", "c5"]), (2, ["r2", "r3", "r4", "c9"]), (3, ["unknown"]), (4, []), (5, ["r7"] * 3 + words[:10])]
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("n,size,k", [(300, 8, 5), (300, 64, 1), (1500, 16, 10), (7, 64, 5)])
def test_equal_to_plain_bm25(spark, n, size, k):
    docs, queries = corpus(spark, n, n)
    ix = index.build(docs)
    found, _ = blockmax.BlockIndex.build(ix, range_docs=size).search(queries, k)
    assert rows(found) == rows(search.bm25(queries, ix, k))


def test_blocks_are_skipped(spark):
    """Where rare words decide, most blocks are never opened; the work says which."""
    docs, queries = corpus(spark, 6000, 3)
    ix = index.build(docs)
    blocks = blockmax.BlockIndex.build(ix, range_docs=16)
    found, work = blocks.search(queries, 5)
    assert rows(found) == rows(search.bm25(queries, ix, 5))
    took = {r["query_id"]: r for r in work.collect()}
    assert set(took) == {0, 1, 2, 5}
    assert took[0]["scored_blocks"] < 0.5 * took[0]["blocks"] and took[2]["scored_blocks"] < 0.5 * took[2]["blocks"]
    assert sum(r["scored_blocks"] for r in took.values()) < 0.7 * sum(r["blocks"] for r in took.values())
    assert all(r["scored_ranges"] <= r["ranges"] for r in took.values())


def test_equal_documents_tie_by_id(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"]) for i in range(200)], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["b"]), (2, ["a"])], "query_id long, tokens array<string>")
    ix = index.build(docs)
    found, _ = blockmax.BlockIndex.build(ix, range_docs=4).search(queries, 5)
    assert rows(found) == rows(search.bm25(queries, ix, 5))


def test_blocks_hold_every_posting_by_falling_gain(spark):
    docs, _ = corpus(spark, 200, 8)
    ix = index.build(docs)
    blocks = blockmax.BlockIndex.build(ix, range_docs=16).blocks.collect()
    assert sum(r["n"] for r in blocks) == ix.tf.count() == sum(len(r["postings"]) for r in blocks)
    assert all([p["gain"] for p in r["postings"]] == sorted((p["gain"] for p in r["postings"]), reverse=True) and r["top"] == r["postings"][0]["gain"] for r in blocks)


def test_save_and_load(spark, tmp_path):
    docs, queries = corpus(spark, 100, 9)
    blocks = blockmax.BlockIndex.build(index.build(docs))
    blocks.save(f"file://{tmp_path}")
    assert rows(blockmax.BlockIndex.load(spark, f"file://{tmp_path}").search(queries)[0]) == rows(blocks.search(queries)[0])


def test_empty(spark):
    docs, queries = corpus(spark, 0, 1)
    found, work = blockmax.BlockIndex.build(index.build(docs)).search(queries)
    assert found.count() == 0 and work.count() == 0
