import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus, evaluate, fusion, index, rag, search, vector

DOCS = [(1, "red fox runs red"), (2, "blue fox"), (3, "green bird sings"), (4, None), (5, "red red red")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", "text", T.tokens(F.col("text")).alias("tokens"))


@pytest.fixture(scope="module")
def ix(docs):
    return index.build(docs)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string").withColumn("tokens", T.tokens(F.col("query")))


def ranks(df, *columns):
    return [tuple(r) for r in df.orderBy("query_id", "rank").select("query_id", "doc_id", *columns).collect()]


def bm25(query, k1=1.25, b=0.6):
    toks = {d: (t or "").split() for d, t in DOCS}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    vocabulary = {w for t in toks.values() for w in t}
    df = {w: sum(w in t for t in toks.values()) for w in vocabulary}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    return {d: round(sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avgdl)) for w in query.split()), 6) for d, t in toks.items()}


def test_index(spark, ix, docs):
    assert ix.n == 5 and ix.avgdl == 12 / 5
    assert {(r.token, r.doc_id) for r in index.postings(docs).collect()} == {(r.token, r.doc_id) for r in ix.tf.collect()}
    lists = {r.token: r.doc_ids for r in index.posting_lists(index.postings(docs)).collect()}
    assert lists["red"] == [1, 5] and lists["fox"] == [1, 2]


def test_posting_lists_come_in_bounded_parts(spark):
    post = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 7), ("b", 7)], "token string, doc_id long")
    rows = index.posting_lists(post, 10).collect()
    assert sorted(x for r in rows if r.token == "a" for x in r.doc_ids) == list(range(100)) and {r.n_docs for r in rows if r.token == "a"} == {100}
    assert len([r for r in rows if r.token == "a"]) >= 8 and max(len(r.doc_ids) for r in rows) < 30
    assert [(r.n_docs, r.part, r.doc_ids) for r in rows if r.token == "b"] == [(1, 0, [7])]


STEMS = [(1, "running foxes run"), (2, "the runner runs"), (3, "a fox"), (4, None)]


def test_stemmed_search_equals_a_plain_one(spark, tmp_path):
    from lexloom.functions.stem import stem

    d = spark.createDataFrame(STEMS, "doc_id long, text string").select("doc_id", T.terms(F.col("text")).alias("tokens"))
    ix = index.build(d, stem=True)
    plain = {i: [stem(w) for w in (t or "").split() if w not in T.STOP_WORDS] for i, t in STEMS}
    assert {(r.token, r.doc_id, r.f, r.len) for r in ix.tf.collect()} == {(w, i, t.count(w), len(t)) for i, t in plain.items() for w in t}
    ix.save(f"file://{tmp_path}/ix")
    back = index.Index.load(spark, f"file://{tmp_path}/ix")
    q = spark.createDataFrame([(0, "the run"), (1, "of the"), (2, "foxes running")], "query_id long, query string").withColumn("tokens", T.terms(F.col("query")))
    assert {(r.query_id, r.doc_id, r.score) for r in search.overlap(q, back.tf.select("token", "doc_id"), stem=back.stem).collect()} == {(0, 1, 1), (0, 2, 1), (2, 1, 2), (2, 2, 1), (2, 3, 1)}
    n, avgdl = len(plain), sum(map(len, plain.values())) / len(plain)
    words = {w for t in plain.values() for w in t}
    raw = {w: math.log(n - sum(w in t for t in plain.values()) + 0.5) - math.log(sum(w in t for t in plain.values()) + 0.5) for w in words}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    for r in search.bm25(q, back).collect():
        t = plain[r.doc_id]
        asked_for = [stem(w) for w in ("run",) if r.query_id == 0] or ["fox", "run"]
        want = sum(idf[w] * t.count(w) * 2.25 / (t.count(w) + 1.25 * (0.4 + 0.6 * len(t) / avgdl)) for w in asked_for)
        assert r.score == pytest.approx(want, abs=1e-6)


def test_stemmed_queries_of_a_table(spark):
    import __spark_entry__
    from lexloom.functions.stem import stem

    sf = "/root/testdata/sf0.001"
    words = lambda t: [stem(w) for w in (x for x in __import__("regex").findall(T.TOKEN, (t or "").lower()) if x != "_") if w not in T.STOP_WORDS]
    docs = {r.doc_id: set(words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        q = words(r.text)
        best = sorted((-sum(w in d for w in q), i) for i, d in docs.items() if any(w in d for w in q))[:5]
        want |= {(r.item_id, i, -s) for s, i in best}
    assert {(r.query_id, r.doc_id, r.score) for r in __spark_entry__.queries()["overlap_topk_stemmed"](spark, sf).collect()} == want
    assert {r.stem for r in __spark_entry__.queries()["stem_vocabulary"](spark, sf).limit(500).collect()} and all(r.stem == stem(r.token) for r in __spark_entry__.queries()["stem_vocabulary"](spark, sf).collect())


def test_index_round_trip(spark, ix, tmp_path):
    ix.save(f"file://{tmp_path}/ix")
    back = index.Index.load(spark, f"file://{tmp_path}/ix")
    assert (back.n, back.avgdl, back.avg_idf) == (ix.n, ix.avgdl, ix.avg_idf) and back.tf.count() == ix.tf.count()


def test_overlap_counts_repeated_query_tokens(spark, docs):
    post = index.postings(docs)
    assert ranks(search.overlap(asked(spark, "fox fox red", "none", ""), post), "score") == [(0, 1, 3), (0, 2, 2), (0, 5, 1)]


def test_bm25(spark, ix):
    for q in ("red fox", "red red bird", "unknown"):
        want = sorted(((-s, d) for d, s in bm25(q).items() if s), key=lambda x: (x[0], x[1]))
        assert ranks(search.bm25(asked(spark, q), ix), "score") == [(0, d, -s) for s, d in want]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_bm25_padding_equals_an_exhaustive_ranking(spark, ix, k):
    qs = ("red fox", "bird", "unknown")
    got = ranks(search.bm25(asked(spark, *qs, ""), ix, k, pad_zero=True), "score")
    want = [(i, d, s) for i, q in enumerate(qs) for s, d in [(-x, d) for x, d in sorted((-s, d) for d, s in bm25(q).items())[:k]]]
    assert got == [(i, d, s + 0.0) for i, d, s in want]


def test_unmatched_grows_until_it_finds_enough(spark, monkeypatch):
    monkeypatch.setattr(search, "PREFIX_IDS", 3)
    ids = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    q = spark.createDataFrame([(0,), (1,), (2,), (3,)], "query_id long")
    rows = [(0, i) for i in range(190)] + [(1, 0), (1, 2)] + [(2, i) for i in range(200)] + [(3, i) for i in range(0, 200, 2)]
    got = search.unmatched(q, spark.createDataFrame(rows, "query_id long, doc_id long"), ids, 3).collect()
    assert sorted(map(tuple, got)) == [(0, 190), (0, 191), (0, 192), (1, 1), (1, 3), (1, 4), (3, 1), (3, 3), (3, 5)]
    assert search.unmatched(q, spark.createDataFrame([], "query_id long, doc_id long"), ids.limit(0), 3).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_sweep_of_many_documents_equals_single_runs(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 30)))) for i in range(80)]
    ix = index.build(spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", T.tokens(F.col("text")).alias("tokens")))
    q = asked(spark, "c d", "b", "e f g h c")
    grid = [(0.5, 0.4), (1.25, 0.75), (2.0, 1.0)]
    got = search.bm25_sweep(q, ix, grid)
    for k1, b in grid:
        assert ranks(got.filter((F.col("k1") == k1) & (F.col("b") == b)), "score") == ranks(search.bm25(q, ix, 5, k1, b), "score")


def test_sweep_equals_single_runs(spark, ix):
    q = asked(spark, "red fox", "green bird")
    grid = [(0.5, 0.4), (2.0, 1.0)]
    got = search.bm25_sweep(q, ix, grid)
    for k1, b in grid:
        assert ranks(got.filter((F.col("k1") == k1) & (F.col("b") == b)), "score") == ranks(search.bm25(q, ix, 5, k1, b), "score")


def test_topk_plans_keep_group_limits(spark, ix):
    plan = search.bm25(asked(spark, "red"), ix)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_cosine_and_zero_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)] + [(50, [0.0] * 4), (51, None), (52, [1.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = spark.createDataFrame(rows[:7] + rows[50:52], "query_id long, embedding array<double>")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows[:50]}
    want = [(a, d, r) for a in range(7) for r, (_, d) in enumerate(sorted((-round(float(unit[a] @ unit[d]), 5), d) for d in unit)[:5], 1)]
    assert ranks(vector.cosine(q, v), "rank") == want
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 2)
    assert ranks(vector.cosine(q, v), "rank") == want


def test_lsh_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    v = e.filter("vec_id >= 20").select(F.col("vec_id").alias("doc_id"), "embedding")
    assert vector.recall(vector.lsh_search(q, v, 64), vector.cosine(q, v)).agg(F.avg("recall")).first()[0] >= 0.85


def test_lsh_index_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 3000)] + 0.3 * rng.normal(size=(3000, 32))
    x[1000:2000] = x[0]  # a third are copies of one
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 32), (9002, [1.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    vector.LshIndex.build(v, 32).save(f"file://{tmp_path}/ix")
    ix = vector.LshIndex.load(spark, f"file://{tmp_path}/ix")
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    found, truth = ix.search(q, but_self=True), vector.cosine(q, v, but_self=True)
    assert ix.measured >= 0.95 and vector.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9
    pairs, nodes = ix.candidates(q).count(), ix.nodes.count()
    assert nodes == 2000 and pairs <= 0.2 * nodes * q.filter("size(embedding) = 32").count()
    copies = found.filter("query_id = 1000").orderBy("rank").collect()
    assert [r.doc_id for r in copies] == [0, 1001, 1002, 1003, 1004]


def test_lsh_order_grows_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "doc_id long, embedding array<double>")
    assert vector.LshIndex.build(v, 8).order == 1
    monkeypatch.setattr(vector, "BUCKET_ROWS", 4)
    ix = vector.LshIndex.build(v, 8)
    assert ix.order == 2
    q = v.withColumnRenamed("doc_id", "query_id")
    assert vector.recall(ix.search(q, but_self=True), vector.cosine(q, v, but_self=True)).agg(F.avg("recall")).first()[0] >= 0.85


def test_rerank_pairs_have_the_parts_that_are_there(spark):
    d = spark.createDataFrame([(1, "T", " ", "D"), (2, None, "S", "")], "doc_id long, title string, summary string, description string")
    c = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "query_id long, doc_id long")
    q = spark.createDataFrame([(0, "q")], "query_id long, query string")
    assert {r.doc_id: r.text for r in fusion.rerank_pairs(c, q, d).collect()} == {1: "T D", 2: "S", 9: "9"}
    assert fusion.model_rerank(fusion.rerank_pairs(c, q, d), lambda p: [float(len(t)) for _, t in p], 1).first().doc_id == 1


def test_embedder_is_unit_length(spark, ix):
    for r in vector.embed(ix.tf, ix.idf, "doc_id", 16).collect():
        assert r.embedding is None or sum(x * x for x in r.embedding) == pytest.approx(1)


def test_rrf(spark):
    a = spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(0, 8, 1), (0, 9, 2)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in fusion.rrf(a, b).collect()}
    assert got == {8: pytest.approx(1 / 12 + 1 / 11), 7: pytest.approx(1 / 11), 9: pytest.approx(1 / 12)}
    assert got == {r.doc_id: r.score for r in fusion.rrf(b, a).collect()}


def test_rerank(spark, ix, docs):
    q = asked(spark, "red bird")
    cand = spark.createDataFrame([(0, 1), (0, 3), (0, 4), (0, 99)], "query_id long, doc_id long")
    got = dict((d, s) for _, d, s in ranks(fusion.lexical_rerank(cand, q, ix, 5), "score"))
    assert got[4] == got[99] == 0.0 and 0 < got[1] < got[3] < 1 and got[1] + got[3] == pytest.approx(1, abs=1e-5)
    texts = cand.join(docs.select("doc_id", "text"), "doc_id").withColumn("query", F.lit("q"))
    assert ranks(fusion.model_rerank(texts, lambda pairs: [float(len(t or "")) for _, t in pairs], 1))[0][:2] == (0, 1)


def metric_row(spark, ret, gold, k=5):
    r = spark.createDataFrame([("m", 0, d, i) for i, d in enumerate(ret, 1)], "method string, query_id long, doc_id string, rank long")
    g = spark.createDataFrame([(0, d, i) for i, d in enumerate(gold, 1)], "query_id long, doc_id string, pos long")
    keys = spark.createDataFrame([("m", 0)], "method string, query_id long")
    x = evaluate.metrics(r, g, keys, k).first()
    return x.overlap, x.p_at_k, x.r_at_k, x.ap, x.mrr, x.ndcg


@pytest.mark.parametrize("ret, gold, want", [
    ("bxa", "abc", (2, 2 / 3, 2 / 3, 0.555556, 1, 0.692020)), ("a", "abcad", (1, 1, 0.25, 0.25, 1, 0.140534)), ("ab", "abcde", (2, 1, 0.4, 0.4, 1, None)),
    ("", "abc", (0,) * 6), ("abc", "", (0,) * 6), ("abcde", "ace", (3, 0.6, 1, 0.755556, 1, None)), ("xa", "a", (1, 0.5, 1, 0.5, 0.5, None)),
])
def test_metrics(spark, ret, gold, want):
    got = metric_row(spark, ret, gold)
    for g, w in zip(got, want):
        assert w is None or g == pytest.approx(w, abs=1e-6)
    assert 0 <= got[5] <= 1


def test_long_gold_lists_do_not_overflow(spark):
    gold = [f"d{i}" for i in range(3000)]
    assert metric_row(spark, gold[:5], gold)[5] == pytest.approx(1)


def test_comparison(spark):
    rows = [("a x", 0, 1.0, 1.0, 0.5, 1.0, 0.9), ("a x", 1, 0.0, 0.0, 0.5, 0.0, 0.1), ("b x", 0, 0.2, 0.2, 0.5, 1.0, 0.4)]
    per = spark.createDataFrame(rows, "method string, query_id long, p_at_k double, r_at_k double, ap double, mrr double, ndcg double")
    means = evaluate.macro_means(per)
    assert [(r["rank"], r.method) for r in evaluate.ranking(means).orderBy("rank").collect()] == [(1, "a x"), (2, "b x")]
    got = {r.method: r.overall for r in evaluate.overall(means).collect()}
    assert got == {"a x": pytest.approx(0.75), "b x": pytest.approx(0.25)}  # the constant ap is passed over
    s = {r.method: r for r in evaluate.stats(per).collect()}
    assert s["a x"].std == pytest.approx(0.565685) and s["b x"].std is None and s["a x"].n == 2
    assert per.select(evaluate.base_name(F.col("method")).alias("m")).first().m == "a"


def test_corpus(spark):
    df = spark.createDataFrame([("11", 1, "x"), ("12", 2, "y"), (None, 3, "z"), ("12", 2, "last")], "season string, number int, title string")
    assert corpus.exclude(df, "season", [11]).count() == 3
    assert [r.k for r in df.select(corpus.document_key(F.col("season"), F.col("number")).alias("k")).collect()] == ["11x1", "12x2", None, "12x2"]
    last = corpus.dedup_last(df.withColumn("seq", F.monotonically_increasing_id()), "number", "seq")
    assert {r.number: r.title for r in last.collect()}[2] == "last"
    right = spark.createDataFrame([(1, "p"), (1, "q")], "number int, extra string")
    assert corpus.merge_left(df, right, on="number").count() == 5
    good, bad = corpus.quarantine(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), ("v", "int"))
    assert [r.v for r in good.collect()] == [1] and bad.count() == 2


def test_enrichment_has_fallbacks(spark):
    d = spark.createDataFrame([(1, 2, 3, "t", "d")], "doc_id long, season int, number long, title string, description string")
    r = spark.createDataFrame([(0, 1, 1), (0, 2, 42)], "query_id long, rank long, doc_id long")
    got = corpus.enrich(r, d).orderBy("rank").collect()
    assert got[0].title == "t" and (got[1].season, got[1].number, got[1].title) == (0, 0, "Document 42")


def test_answers():
    found = lambda q: [(1, "The fox is red. The sky is blue."), (2, None)]
    a = rag.answer("what is the fox", found)
    assert a.has_answer and "fox is red" in a.answer and a.retrieved_docs[0]["score"] == 1.0 and "1. [1]" in rag.report(a)
    assert rag.answer(" ", found).error and rag.answer("q", lambda q: []).error

    def broken(q):
        raise RuntimeError("down")

    class Off(rag.Extractive):
        def available(self):
            return False

    assert "down" in rag.answer("q", broken).error and rag.answer("q", found, Off()).error
    dead = rag.HttpModel("http://127.0.0.1:9", "m", probe_timeout=0.2, timeout=0.2)
    assert not dead.available() and dead("q", "c") is None
    assert "Question: q" in rag.prompt("q", "c")


def test_lsh_search_makes_no_pairs_and_equals_them(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 8)), 1)
    x[400:] = x[:100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    ix = vector.LshIndex.build(v, 8, recall=0.6)
    q = v.withColumnRenamed("doc_id", "query_id")
    copies, unit = {}, {i: r / np.linalg.norm(r) for i, r in enumerate(x)}
    for r in ix.copies.collect():
        copies.setdefault(r.node, []).append(r.doc_id)
    near = {}
    for r in ix.candidates(q).collect():
        near.setdefault(r.query_id, []).append((-round(float(unit[r.query_id] @ unit[r.node]), 5), r.node))
    want = {}
    for a, found in near.items():
        own = sorted((s, d) for s, node in sorted(found)[:4] for d in copies[node] if d != a)[:3]
        want |= {(a, d): (n, -s) for n, (s, d) in enumerate(own, 1)}
    monkeypatch.setattr(vector.LshIndex, "candidates", lambda *a: pytest.fail("pairs were made"))
    monkeypatch.setattr(vector, "MET_QUERIES", 64)
    got = {(r.query_id, r.doc_id): (r.rank, r.score) for r in ix.search(q, 3, but_self=True).collect()}
    assert {k: (r, round(s, 5) + 0.0) for k, (r, s) in got.items()} == {k: (r, round(s, 5) + 0.0) for k, (r, s) in want.items()}


def test_every_vector_is_asked_and_found_but_by_itself(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    score = np.round(x @ x.T, 5)
    got = __spark_entry__.queries()["ann_lsh_topk"](spark, sf).collect()
    assert {r.query_id for r in got} == set(ids.tolist()) and not any(r.query_id == r.doc_id for r in got) and min(r.doc_id for r in got) < 20
    at = {i: n for n, i in enumerate(ids.tolist())}
    assert all(abs(r.score - score[at[r.query_id], at[r.doc_id]]) < 2e-5 for r in got)
    found = {r.query_id: r for r in __spark_entry__.queries()["ann_recall"](spark, sf).collect()}
    assert set(found) == set(ids.tolist()) and all(r.wanted == 5 for r in found.values())
    hits = {i: set() for i in found}
    for r in got:
        hits[r.query_id].add(r.doc_id)
    for i, r in found.items():
        order = sorted((-score[at[i], at[j]], j) for j in ids.tolist() if j != i)[:5]
        assert abs(r.hits - len(hits[i] & {j for _, j in order})) <= 1
