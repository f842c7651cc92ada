import random

from lexloom.operators import rag, sentences

WORDS = "river boat harbour fish market morning light stone bridge wind".split()


def corpus(seed):
    rng = random.Random(seed)
    text = lambda: " ".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 8))).capitalize() + rng.choice((".", "!", "?\n", " \n")) for _ in range(rng.randint(0, 12)))
    docs = [(i, text()) for i in range(12)] + [(50, None), (51, ""), (52, "...")]
    ranked = [(q, d, r) for q in range(6) for r, d in enumerate(rng.sample([d for d, _ in docs], 4), 1)] + [(9, 50, 1), (9, 51, 2)]
    queries = [(q, " ".join(rng.choices(WORDS + ["the"], k=4))) for q in range(6)] + [(9, "river")]
    return docs, ranked, queries


def test_joins_equal_the_plain_version(spark):
    for seed in (1, 2):
        docs, ranked, queries = corpus(seed)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r["query_id"]: r for r in rag.answers(spark.createDataFrame(ranked, "query_id long, doc_id long, rank long"), spark.createDataFrame(queries, "query_id long, query string"), frame).collect()}
        text = dict(docs)
        for q, question in queries:
            own = sorted((r, d) for x, d, r in ranked if x == q)
            context = "\n---\n".join(f"Document {i}: {(text[d] or '')[:800]}\n" for i, (_, d) in enumerate(own, 1))
            assert got[q]["answer"] == sentences.Extractive()(question, context), (seed, q)
            assert got[q]["n_docs"] == len(own)
        assert got[9]["answer"] is None


def test_no_python_in_the_plan(spark):
    docs, ranked, queries = corpus(1)
    out = rag.answers(spark.createDataFrame(ranked, "query_id long, doc_id long, rank long"), spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_the_question_and_the_links_decide(spark):
    docs = spark.createDataFrame([(1, "Cats sleep. A boat crossed the river. The river carried the boat home. Bread is old.")], "doc_id long, text string")
    ranked, asked = spark.createDataFrame([(1, 1, 1)], "query_id long, doc_id long, rank long"), spark.createDataFrame([(1, "Where did the river carry the boat?")], "query_id long, query string")
    assert rag.answers(ranked, asked, docs).first()["answer"] == "A boat crossed the river. The river carried the boat home."


def test_generators_are_called_in_batches(spark):
    docs, ranked, queries = corpus(2)
    out = rag.answers(spark.createDataFrame(ranked, "query_id long, doc_id long, rank long"), spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), sentences.Extractive(1))
    assert out.count() == 7 and out.first()["source"] == "Extractive"
