import pytest
from pyspark.sql import functions as F

from lexloom.functions import sql
from lexloom.functions.stem import stem
from lexloom.functions.text import tokens
from lexloom.operators import index, search
from lexloom.sources import postings

DOCS = "doc_id long, tokens array<string>"


@pytest.fixture(scope="module")
def built(spark):
    docs = [(i, [f"t{j:03d}" for j in range(i % 50, i % 50 + 20)] + ["every"]) for i in range(400)]
    return index.build(spark.createDataFrame(docs, DOCS))


@pytest.fixture(scope="module")
def saved(spark, built, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('saved')}/index"
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables, several files
    postings.save(built.tf, path, built.n, built.avgdl, built.avg_idf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    return path


def test_scalar_functions(spark):
    sql.register(spark)
    text = "The QUICK_fox, don't _ stop: café 42"
    row = spark.sql("SELECT tokenize({t}) AS t, tokenize(NULL) AS none, stem('running') AS s, stem(NULL) AS n".format(t="\"" + text + "\"")).first()
    assert row["t"] == spark.createDataFrame([(text,)], "x string").select(tokens(F.col("x")).alias("t")).first()["t"]
    assert row["none"] == [] and row["s"] == stem("running") and row["n"] is None
    row = spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS c, cosine(array(0D), array(1D)) AS z, cosine(NULL, array(1D)) AS n").first()
    assert row["c"] == pytest.approx(0.5**0.5) and row["z"] is None and row["n"] is None


def test_scalar_functions_run_without_python(spark):
    sql.register(spark)
    plan = spark.sql("SELECT size(tokenize(text)) FROM VALUES ('a b') AS t(text)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def test_table_function_equals_the_operator(spark, built, saved):
    sql.register(spark, saved)
    asked = [(1, "t005 t006 t007 every"), (2, "t049 T049 nothing"), (3, ""), (4, None), (5, "nothing"), (6, "the every")]
    rows = spark.createDataFrame(asked, "query_id long, q string")
    words = rows.select("query_id", F.filter(tokens(F.col("q")), lambda t: t != "the").alias("tokens"))
    for method, want in (("bm25", search.bm25(words, built, 7)), ("boolean", search.overlap(words, built.tf.select("token", "doc_id"), 7))):
        got = spark.sql("SELECT r.query_id, s.* FROM {r} r, LATERAL search('" + method + "', r.q, 7) s", r=rows).collect()
        assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in got) == sorted((r["query_id"], r["rank"], r["doc_id"], round(float(r["score"]), 5)) for r in want.collect())
    assert spark.sql("SELECT * FROM search('bm25', 'every', 3)").count() == 3
    with pytest.raises(Exception, match="unknown method"):
        spark.sql("SELECT * FROM search('odd', 'every', 3)").collect()


def test_source_opens_the_files_of_the_tokens_only(spark, built, saved):
    files = postings.manifest(saved)
    assert len(files) > 2 and sum(1 for _ in files) == spark.read.parquet(f"{saved}/files").count()
    every = postings.load(spark, saved)
    assert every.rdd.getNumPartitions() == len(files) and every.count() == built.tf.count()
    few = every.filter(F.col("token").isin("t003", "t004"))
    assert few.rdd.getNumPartitions() == len(postings.files_of(saved, frozenset(("t003", "t004")))) < len(files)
    want = built.tf.filter(F.col("token").isin("t003", "t004"))
    rows = lambda df: sorted(tuple(r) for r in df.select("token", "doc_id", "f", "len").collect())
    assert rows(few) == rows(want)
    assert every.filter("token = 'none such'").count() == 0 == every.filter("token = 't003' and token = 't004'").count()
    both = every.filter("token = 't003' and doc_id < 100")
    assert rows(both) == rows(built.tf.filter("token = 't003' and doc_id < 100")) and both.rdd.getNumPartitions() < len(files)
    assert every.filter("token > 't060'").count() == built.tf.filter("token > 't060'").count()


def test_bucketed_postings_join_without_a_shuffle(spark, built, tmp_path):
    from lexloom.sources import files

    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucket_test LOCATION 'file://{tmp_path}/db'")
    files.write_table(built.tf, "bucket_test.postings", "token", buckets=4)
    files.write_table(built.idf, "bucket_test.idf", "token", buckets=4)
    met = spark.table("bucket_test.postings").join(spark.table("bucket_test.idf").hint("merge"), "token")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == built.tf.count()
    spark.sql("DROP DATABASE bucket_test CASCADE")


def test_table_function_calls_are_spread_over_tasks(spark):
    from lexloom.plans import catalog

    found = catalog.QUERIES["sql_search"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
