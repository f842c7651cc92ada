import random

import pytest

from lexloom.operators import components as C


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(rng.choice((40, 70, 200)))]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute(pairs)


@pytest.mark.parametrize("name", ["path of mixed numbers", "star"])
def test_long_and_wide_components(spark, name):
    n = 100
    pairs = {"path of mixed numbers": [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(n)], "star": [(n + 5, i) for i in range(n)]}[name]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute(pairs)


def test_self_links_nulls_and_nothing(spark):
    frame = spark.createDataFrame([("x", "x"), (None, "y"), ("b", "a"), ("b", "a")], "a string, b string")
    assert {r["node"]: r["root"] for r in C.components(frame).collect()} == {"x": "x", "a": "a", "b": "a"}
    assert C.components(frame.limit(0)).count() == 0


def test_aliases(spark):
    ents = [(1, "ada maria lind"), (1, "ada lind"), (1, "lind"), (2, "ada lind"), (2, "lind"), (3, "lind"), (3, "otto lind"), (4, "lind"), (4, "otto lind"), (5, "otto lind"), (6, "bo ek"), (7, "ek")]
    frame = spark.createDataFrame(ents, "doc_id long, name string")
    evidence = {(r["short"], r["long"]): r["docs"] for r in C.alias_evidence(frame).collect()}
    assert evidence == {("ada lind", "ada maria lind"): 1, ("lind", "ada lind"): 2, ("lind", "ada maria lind"): 1, ("lind", "otto lind"): 2}
    got = {r["name"]: r["class"] for r in C.alias_classes(frame).collect()}
    assert got == {n: "ada lind" for n in ("ada lind", "ada maria lind", "lind")}
    assert C.alias_classes(frame, least=3).count() == 0
