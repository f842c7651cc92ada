import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann


def brute(rows, asked, k=20):
    """{query: [(vec_id, score)]} over distinct usable (id, vector) rows."""
    ok = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in filter(asked, ok):
        for v in ok[q]:
            near = [(-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, ws in ok.items() if i != q for w in ws if len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


SCHEMA = "vec_id long, embedding array<float>, score string"


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got, want = collected(ann.query(spark, "/root/testdata/sf0.01")), brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    exact = {(q, i): s for q, w in brute(rows, lambda i: i % 20 == 0, 10**6).items() for i, s in w}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, g in got.items() for i, s in g)


@pytest.mark.parametrize("scaled", [False, True])
def test_many_shards_and_lengths(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * (rng.lognormal(0, 0.5, size=(3000, 1)) if scaled else 1)
    rows = [(i, v.astype(np.float32).tolist(), "s") for i, v in enumerate(x)]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, shard_rows=700))
    assert recall(got, brute(rows, lambda i: i % 20 == 0)) >= 0.95


def test_edges(spark):
    e = [1.0, 0.0]
    rows = [(0, e, "a"), (1, e, "a"), (2, e, "a"), (3, [0.0, 2.0], "a"), (4, [0.5, 0.5], "a"), (4, [0.5, 0.5], "a"), (5, None, "a"), (6, [0.0, 0.0], "a"),
            (7, [float("nan"), 1.0], "a"), (8, [None, 1.0], "a"), (9, [float("inf"), 1.0], "a"), (None, e, "a"), (20, [1.0, 2.0, 3.0], "a"), (21, [1.0, 0.0, 0.0], "a"), (40, [], "a"), (60, None, "a")]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 1.0), (2, 1.0), (4, 0.5), (3, 0.0)], 20: [(21, 1.0)]}


def test_one_vector_in_most_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i % 3 else rng.normal(size=8).astype(np.float32).tolist(), "s") for i in range(900)]
    got, want = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)), brute(rows, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.95
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q % 3)  # ties by id


@pytest.mark.parametrize("factor", [1e5, 1e200, 1e-200])
def test_one_vector_of_another_length(spark, factor):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24))
    x[7] *= factor
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    with np.errstate(over="ignore"):
        got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 20 == 0, 20, shard_rows=600))
        assert recall(got, brute(rows, lambda i: i % 20 == 0)) >= 0.95


def test_products_that_overflow(spark):
    rows = [(0, [1e200, 1e200], "s"), (1, [1e200, 0.0], "s"), (2, [-1e200, 0.0], "s"), (3, [1e200, -1e200], "s"), (4, [1.0, 0.0], "s")]
    got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") == 0))
    assert got[0][:2] == [(1, float("inf")), (4, 1e200)] and {i for i, _ in got[0]} <= {1, 2, 3, 4}


def test_clustered_vectors_visit_few_shards(spark):
    rng = np.random.default_rng(8)
    c = rng.normal(size=(12, 32))
    x = c[rng.integers(0, 12, 3000)] + 0.1 * rng.normal(size=(3000, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = ann.dealt(rows, 20, 250)
    routed = ann.routes(ann.build(nodes, 20, f"{ann.fresh_path(spark, 'files')}"))
    asked = rows.filter("vec_id % 20 = 0")
    visits, ef, reached = ann.tuned(nodes, routed, asked, 20)
    assert reached >= ann.WANTED and visits <= len(routed[32]["shard"]) / 3
    assert sum(r.n for r in nodes.groupBy("shard").agg(F.count("*").alias("n")).collect()) == 3000
    got = collected(ann.search(routed, asked, 20, ef, visits))
    assert recall(got, brute([(i, v.tolist()) for i, v in enumerate(x)], lambda i: i % 20 == 0)) >= 0.95


def test_shards_are_bounded_whatever_the_lengths(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 8)) * np.exp(rng.normal(0, 3, size=(2000, 1)))
    nodes = ann.dealt(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 20, 300)
    sizes = [r.n for r in nodes.groupBy("dim", "shard").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 600 and len(sizes) <= 60


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_flat_arrays_restore_the_graph():
    x = ann.equal_length(np.random.default_rng(3).normal(size=(1500, 8)))
    g = ann.Graph(x)
    h = ann.Graph.of(x, *g.flat())
    assert h.entry == g.entry and all((a == b).all() for a, b in zip(g.levels, h.levels))
    assert all(((m >= -1) & (m < len(x))).all() for m in g.levels)


def test_beams_that_miss_the_recall_give_way_to_whole_shards(spark, monkeypatch):
    """With beams that cannot reach the recall wanted, the shards visited are scored whole."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), "s") for i, v in enumerate(rng.normal(size=(3000, 24)))]
    monkeypatch.setattr(ann, "EF_SEARCH", (1,))
    monkeypatch.setattr(ann, "WANTED", 2.0)
    seen = []
    tuned = ann.tuned
    monkeypatch.setattr(ann, "tuned", lambda *a: seen.append(tuned(*a)) or seen[-1])
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, shard_rows=1000))
    assert seen[0][1] == ann.EXACT and seen[0][2] >= ann.REACH
    assert recall(got, brute(rows, lambda i: i % 20 == 0)) >= 0.97
