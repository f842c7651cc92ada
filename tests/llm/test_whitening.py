import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string, n string, whitened string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, "c", "n", "w") for i, v in rows], SCHEMA).repartition(parts)


def rows_of(out):
    found = {}
    for r in out.collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    return found


def plain(vectors):
    """(whitened, explained, deviations) with numpy's own eigenvectors of the exactly centred integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    spread = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    e = s * s / n
    return y @ vt.T / np.sqrt(e), e / e.sum(), spread


@pytest.mark.parametrize("dim,count,shift", [(5, 40, 0.0), (12, 300, 3e4), (33, 200, -7.0), (1, 9, 0.0)])
def test_brute_force(spark, dim, count, shift):
    rng = np.random.default_rng(dim)
    data = rng.normal(size=(count, dim)) * np.logspace(0, -1, dim) * 20 + shift
    out = rows_of(W.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(data)])))
    want, explained, spread = plain(data.tolist())
    shown = min(32, dim)
    assert set(out) == set(range(count)) and all(set(r) == set(range(1, shown + 1)) for r in out.values())
    got = np.array([[out[i][c + 1]["whitened"] for c in range(shown)] for i in range(count)])
    signs = np.sign((got * want[:, :shown]).sum(axis=0))
    assert np.abs(got - want[:, :shown] * signs).max() < 1e-6
    assert np.allclose([out[0][c + 1]["explained"] for c in range(shown)], explained[:shown], rtol=1e-9)
    assert [out[i][1]["deviation"] for i in range(count)] == spread
    assert {r["n"] for x in out.values() for r in x.values()} == {count}
    errors = {r["identity_error"] for x in out.values() for r in x.values()}
    assert len(errors) == 1 and errors.pop() < 1e-10


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    wanted = np.logspace(0, -14, 20)
    v, s = W.jacobi((np.linalg.qr(rng.normal(size=(20, 20)))[0] * wanted) @ q.T)
    assert np.allclose(s, wanted, rtol=1e-2, atol=1e-16) and np.allclose(s[:10], wanted[:10], rtol=1e-7)
    assert np.abs(v.T @ v - np.eye(20)).max() < 1e-13


def test_graded_columns_keep_relative_accuracy():
    r = np.linalg.qr(np.random.default_rng(2).normal(size=(30, 6)), mode="r") * np.array([1, 1e-6, 1e6, 1e-12, 1.0, 1e-3])
    _, s = W.jacobi(r)
    scale = np.array([1e6, 1, 1, 1e-3, 1e-6, 1e-12])
    product = np.prod(np.abs(np.diag(r)))
    assert np.isclose(np.prod(s), product, rtol=1e-10) and (np.abs(np.log10(s / scale)) < 2).all()


def test_tsqr_levels(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 7))
    rows = spark.createDataFrame([(v.tolist(),) for v in data], "embedding array<double>").repartition(40)  # three levels of 16
    r = W.tsqr(rows, lambda lists: W.matrix(lists, 7), 7)
    assert np.allclose(r.T @ r, data.T @ data)


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i % 7), float(i * i % 5), float(i % 3)]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [math.nan, 1.0, 2.0]), (104, [math.inf, 1.0, 2.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    out = rows_of(W.whiten(frame(spark, good + bad + [(None, [9.0, 9.0, 9.0])])))
    assert set(out) == {i for i, _ in good} | {None}
    assert {r["n"] for x in out.values() for r in x.values()} == {31}


def test_repeated_rows_are_counted(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [2.0, 5.0])]
    out = W.whiten(frame(spark, rows)).collect()
    assert len(out) == 10 and len({(r["component"], round(r["whitened"], 9)) for r in out if r["vec_id"] == 1}) == 2


def test_without_variance(spark):
    out = W.whiten(frame(spark, [(1, [2.0, 3.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(out, key=lambda r: r["component"])] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    line = rows_of(W.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])))
    assert all(r[1]["whitened"] is not None and r[2]["whitened"] is None and r[3]["whitened"] is None for r in line.values())


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**50 + 3 * i), float(i % 4)]) for i in range(12)]
    out = W.whiten(frame(spark, rows))
    model = W.fit(frame(spark, rows))
    _, _, spread = plain([v for _, v in rows])
    got = {r["vec_id"]: int(r["deviation"]) for r in W.transform(frame(spark, rows), model).collect()}
    assert [got[i] for i in range(12)] == spread and out.count() == 24


def test_empty(spark):
    out = W.whiten(frame(spark, [], 1))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = W.query(spark, "/root/testdata/sf0.001")
    want, explained, spread = plain([r["embedding"] for r in vectors.orderBy("vec_id").collect()])
    got = out.groupBy("component").pivot("vec_id").agg(F.first("whitened")).orderBy("component").collect()
    got = np.array([r[1:] for r in got]).T
    signs = np.sign((got * want[:, :32]).sum(axis=0))
    assert np.abs(got - want[:, :32] * signs).max() < 1e-6
    assert [r["deviation"] for r in out.filter("component = 1").orderBy("vec_id").collect()] == spread
