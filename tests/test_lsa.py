import numpy as np
import pytest

from lexloom.operators import lsa, search, vector
from lexloom.plans import catalog

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def dense(rows, slots):
    out = np.zeros((len(rows), slots))
    for i, r in enumerate(rows):
        out[i, r["slots"]] = r["weights"]
    return out


def test_values_are_those_of_the_whole_matrix(spark):
    """On the smallest table, against numpy's decomposition of all rows."""
    model, docs, _ = catalog.latent(spark, TINY)
    ix = catalog.built(spark, TINY)
    a = dense(lsa.rows(ix.tf, ix.idf, "doc_id").orderBy("doc_id").collect(), lsa.SLOTS)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert len(model.values) == 64 and np.abs(model.values / s[:64] - 1).max() < 1e-3 and (np.diff(model.values) <= 1e-6).all()
    assert np.abs(model.basis.T @ model.basis - np.eye(64)).max() < 1e-4
    # the first directions, which are well apart, are numpy's up to their sign
    assert (np.abs((model.basis[:, :3] * vt[:3].T).sum(axis=0)) > 0.999).all()
    got = np.array([r["embedding"] for r in docs.orderBy("doc_id").collect()])
    want = a @ model.basis / model.values**2
    want /= np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert np.abs(got - want).max() < 1e-4


def share_found(found, gold):
    return gold.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count() / gold.count()


def test_finds_more_than_hashing(spark):
    """Of the documents that hold a passage, more are among its five nearest than with hashed vectors of the same size."""
    gold = catalog.gold_of(spark, SMALL)
    _, docs, passages = catalog.latent(spark, SMALL)
    hashed = vector.cosine(catalog.query_vectors(spark, SMALL), catalog.doc_vectors(spark, SMALL))
    assert share_found(vector.cosine(passages, docs), gold) > share_found(hashed, gold)


def test_low_rank(spark):
    """Rows of three directions give three, in any partitioning, and none where all are equal but one."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 40))
    a = rng.normal(size=(50, 3)) @ base
    a /= np.sqrt((a * a).sum(axis=1, keepdims=True))
    rows = [(i, list(range(40)), v.tolist()) for i, v in enumerate(a)]
    for parts in (1, 70):
        table = spark.createDataFrame(rows, "id long, slots array<int>, weights array<float>").repartition(parts)
        model = lsa.Lsa.fit(table, 8, slots=64)
        assert len(model.values) == 3 and np.allclose(model.values, np.linalg.svd(a, compute_uv=False)[:3], rtol=1e-4)


def test_rows(spark):
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "unknown", 1), (3, "b", 4)], "id long, token string, f long")
    idf = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "token string, idf double")
    got = {r["id"]: r for r in lsa.rows(terms, idf, "id").collect()}
    assert set(got) == {1, 3} and [abs(w) for w in got[3]["weights"]] == [1.0]
    assert got[1]["slots"] == sorted(got[1]["slots"]) and sum(w * w for w in got[1]["weights"]) == pytest.approx(1)


def test_long_rows_are_cut_into_pieces_of_whole_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, sorted(rng.choice(64, size=n, replace=False).tolist()), [0.1] * n) for i, n in enumerate((64, 1, 5, 33, 2))]
    table = spark.createDataFrame(rows, "id long, slots array<int>, weights array<float>").coalesce(1)
    model = lsa.Lsa.fit(table, 3, slots=64)
    whole = sorted(tuple(r["embedding"]) for r in model.embed(table, "id").collect())
    monkeypatch.setattr(lsa, "ENTRIES", 4)
    assert np.allclose(whole, sorted(tuple(r["embedding"]) for r in model.embed(table, "id").collect()), atol=1e-6)


def test_save_and_load(spark, tmp_path):
    model = catalog.latent(spark, TINY)[0]
    model.save(f"file://{tmp_path}/m", spark)
    again = lsa.Lsa.load(spark, f"file://{tmp_path}/m")
    assert (again.basis == model.basis).all() and (again.values == model.values).all()


def test_empty(spark):
    table = spark.createDataFrame([], "id long, slots array<int>, weights array<float>")
    model = lsa.Lsa.fit(table, 4, slots=64)
    assert len(model.values) == 0


def test_passages_without_known_words_have_no_vector(spark):
    ix = catalog.built(spark, TINY)
    q = spark.createDataFrame([(1, ["notaword"])], "query_id long, tokens array<string>")
    terms = search.query_terms(q).withColumnRenamed("m", "f")
    assert catalog.latent(spark, TINY)[0].embed(lsa.rows(terms, ix.idf, "query_id"), "query_id").count() == 0


def test_a_pass_sums_few_blocks(spark, monkeypatch):
    """However many parts the table has; each would write and sum a whole block in every pass."""
    rows = [(i, [i % 64], [1.0]) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, slots array<int>, weights array<float>").repartition(100)
    seen, squared = [], lsa._squared
    monkeypatch.setattr(lsa, "_squared", lambda t, x, parts: seen.append(parts) or squared(t, x, parts))
    lsa.Lsa.fit(table, 4, slots=64)
    assert seen and max(seen) <= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("cells", [1, 1 << 12])
def test_groups_of_rows_are_multiplied_whole(cells):
    rng = np.random.default_rng(4)
    a = np.where(rng.random((20, 64)) < 0.2, rng.normal(size=(20, 64)), 0).astype(np.float32)
    a[:, 7] = 1
    row, slots = np.nonzero(a)
    x, room, total = rng.normal(size=(64, 5)).astype(np.float32), np.zeros(cells, np.float32), np.ones((64, 5), np.float32)
    lsa.add_squared(total, x, row, slots, a[row, slots], room)
    assert np.allclose(total, 1 + a.T @ (a @ x), atol=1e-4) and not room.any()
