import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, w string"


def water(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: most * sizes[s] for s in order}
    target, left, full = {}, sum(sizes.values()) * percent / 100, set()
    while True:
        rest = [s for s in order if s not in full]
        total = sum(w[s] for s in rest)
        share = {s: left * w[s] / total for s in rest} if rest else {}
        over = [s for s in rest if share[s] >= cap[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            full.add(s)


def coin(doc_id):
    return int(hashlib.md5(f"{mixing.SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16) / 2**32


def test_brute_force(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), [None, "a", "b", "é", "z", "zz"][i * i % 6], "t", "x") for i in range(500)]
    rows += [(None, "a b c", "a", "t", "x"), (7, None, "a", "t", "x"), (7, "", None, "t", "x"), (8, "dup words here", "b", "t", "x"), (8, "dup words here", "b", "t", "x"), (9, "only", "single", "t", "x")]
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        copies = int(rate) + (coin(r.doc_id) < rate - int(rate))
        assert r.copies == copies and r.taken == copies * r["size"] <= 2 * r["size"]
    assert sum(r.copies for r in got) == mixing.emit(spark.createDataFrame(got)).count()


def test_targets_stop_at_their_sources(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 10, "d": 0}, {"a": 1}, {"a": 0, "b": 0}, {"a": 3, "b": 3, "c": 3}, {None: 5, "x": 100_000}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = water(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
        assert got == {k: pytest.approx(v) for k, v in want.items()}
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[k] <= 2 * v + 1e-9 for k, v in sizes.items())


def test_near_targets_and_stable(spark):
    d = "/root/testdata/sf0.1"
    a = mixing.query(spark, d)
    per = a.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.15 * r.g for r in per)
    total = lambda df: df.agg(F.sum(F.xxhash64("doc_id", "taken", "target") % 1000003)).first()[0]
    assert total(a) == total(mixing.query(spark, d))


def test_empty_table(spark):
    out = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and mixing.emit(out).count() == 0


def test_native_plan(spark):
    plan = mixing.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
