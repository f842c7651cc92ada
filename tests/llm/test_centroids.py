import hashlib
import math

import numpy as np
import pytest

from lexloom.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, q string, m string, cluster string, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "q", "m", "c", "d") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k, rounds, dim, scale=64, seed="1"):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < C.LARGEST for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [r[1] for r in sorted(ok, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in ok:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    each = [(i, *nearest(v)[::-1]) for i, v in ok]
    own = {}
    for _, j, d in each:
        own[j] = own.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, own[j], sum(own.values()), digest[j]) for i, j, d in each), key=repr)


def got(out):
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [(rng.normal(size=4) * [1, 3, 10, 0.05]).tolist() for _ in range(120)]
    rows = [(i, vectors[i % 120 if i < 150 else 7]) for i in range(400)]  # one vector makes up most rows
    rows += [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 0.0, 0.0]), (504, [math.nan] * 4), (505, [math.inf] + [0.0] * 3), (506, [1e300] * 4)]
    rows += [(None, vectors[1]), (None, vectors[2]), (7, vectors[3]), (7, vectors[3]), (600, [-0.001, 0.0, -1e-9, 2.0])]
    assert got(C.cluster(frame(spark, rows), 5, 3, dim=4)) == brute(rows, 5, 3, 4)


def test_ties_and_empty_centroids(spark):
    """Equal first centroids: the smaller number takes all, the others stay empty and keep their place."""
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(100 + i, [1.0, -1.0]) for i in range(3)]
    out = C.cluster(frame(spark, rows), 6, 2, dim=2)
    assert got(out) == brute(rows, 6, 2, 2)


def test_fewer_vectors_than_centroids(spark):
    rows = [(3, [0.5, 2.0]), (4, [0.25, -2.0])]
    assert got(C.cluster(frame(spark, rows), 16, 3, dim=2)) == brute(rows, 16, 3, 2)


def test_large_entries(spark):
    rows = [(i, [(-1) ** i * (C.LARGEST - 1 - i), float(i)]) for i in range(20)]
    assert got(C.cluster(frame(spark, rows), 3, 2, dim=2)) == brute(rows, 3, 2, 2)


def test_shuffled_and_broadcast_labels_agree(spark, monkeypatch):
    rows = [(i, [float(i % 13), float(i % 7)]) for i in range(200)]
    want = brute(rows, 4, 3, 2)
    for part in (1, 8, 1024):
        monkeypatch.setattr(C, "HOT_PART", part)
        assert got(C.cluster(frame(spark, rows), 4, 3, dim=2)) == want


def test_empty(spark):
    out = C.cluster(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distinct_vectors_carry_the_rounds(spark):
    """Rounds read distinct vectors: their number is that of different quantised vectors, not of rows."""
    rows = frame(spark, [(i, [i % 5 + 0.001 * (i % 2), 0.0]) for i in range(300)])
    kept = C.kept(rows, 2)
    assert kept.count() == 300 and kept.select("q").distinct().count() == 5
