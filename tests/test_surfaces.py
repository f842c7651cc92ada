import json
import sqlite3
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lexloom import api, cli
from lexloom.sources import files
from lexloom.storage import bounded_batches, cut, shared_dir
from lexloom.streaming import incremental


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1, 1, 1, "Red fox", "The red fox runs through the wood.", "A fox."), (2, 1, 2, "Blue bird", "A blue bird sings in the morning.", None), (3, 2, 1, "Rain", None, "It rains.")]
    return api.Engine.build(spark.createDataFrame(rows, "doc_id long, season int, number long, title string, description string, summary string"))


@pytest.mark.parametrize("method", api.METHODS)
def test_search(engine, method):
    got = engine.search("red fox", method)
    assert got[0]["doc_id"] == 1 and got[0]["title"] == "Red fox" and got[0]["rank"] == 1


def test_validation(engine):
    for bad in (("", "bm25"), (" ", "bm25"), ("x", "bm25"), ("fox", "rag"), ("fox", "nope"), (None, "bm25")):
        with pytest.raises(ValueError):
            engine.search(*bad)
    assert engine.rag("").error and engine.rag("red fox").has_answer


def test_http(engine):
    server = api.serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path: urllib.request.urlopen(base + path).read()
    post = lambda path, body: json.loads(urllib.request.urlopen(base + path, json.dumps(body).encode()).read())
    assert b"<select" in get("/") and len(json.loads(get("/api/methods"))["methods"]) == 6
    assert post("/api/search", {"query": "red fox", "method": "bm25"})["results"][0]["doc_id"] == 1
    assert post("/api/rag", {"query": "where does the fox run"})["has_answer"]
    assert api.handle(engine, "POST", "/api/search", b"{}")[0] == 400 and api.handle(engine, "GET", "/x")[0] == 404
    assert api.handle(engine, "POST", "/api/search", b"not json")[0] == 400
    server.shutdown()


def test_cli(spark, tmp_path, capsys):
    d = "/root/testdata/sf0.001"
    assert cli.main(["--data", d, "--mode", "search", "--query", "the of", "--search-method", "bm25", "--keep-stop-words", "--no-stems"], spark) == 0
    assert cli.main(["--data", d, "--mode", "rag", "--query", "the of and", "--keep-stop-words"], spark) == 0
    assert "1. [" in capsys.readouterr().out
    built = f"file://{tmp_path}/built"
    assert cli.main(["--data", d, "--mode", "build", "--index", built], spark) == 0
    assert "documents" in capsys.readouterr().out
    assert cli.main(["--index", built, "--mode", "search", "--query", "the of", "--search-method", "boolean"], spark) == 0
    assert "1. [" not in capsys.readouterr().out  # stop words find nothing by default
    word = spark.read.parquet(f"{built}/inverted_index").first()["token"]
    for method in ("boolean", "ann"):
        assert cli.main(["--index", built, "--mode", "search", "--query", word + " " + word, "--search-method", method], spark) == 0
    assert cli.main(["--data", d, "--sweep-bm25", "--k1-values", "1.0", "--b-values", "0.5", "0.6", "--output", f"file://{tmp_path}/s"], spark) == 0
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/s").count() == 2
    for bad in (["--data", d, "--mode", "search"], ["--mode", "eval"], ["--data", d, "--mode", "build"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
    assert "1. [" in capsys.readouterr().out


def test_csv_sources(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y, \"q\"", 2)], "title string, n int")
    b = spark.createDataFrame([("x", "s1"), ("x", "s2")], "title string, summary string")
    files.write_csv(a, f"file://{tmp_path}/a")
    files.write_csv(b, f"file://{tmp_path}/b")
    sources = {f"file://{tmp_path}/a": "title string, n int", f"file://{tmp_path}/b": "title string, summary string"}
    got = files.load_merged(spark, f"file://{tmp_path}/m", "", sources, "title")
    assert got.count() == 3 and 'y, "q"' in {r.title for r in got.collect()}
    files.write_csv(got, f"file://{tmp_path}/m")
    assert files.load_merged(spark, f"file://{tmp_path}/m", "title string, n int, summary string", {}, "title").count() == 3
    with pytest.raises(FileNotFoundError):
        files.load_merged(spark, f"file://{tmp_path}/none", "", {f"file://{tmp_path}/nope": "a int"}, "a")


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"queries": ["a b", "c"], "answers": [["x", "y", "x"], []]}))
    (tmp_path / "m.json").write_text(json.dumps({"0": "d0", "1": "d1"}))
    q, gold = files.read_query_set(spark, f"file://{tmp_path}/q.json")
    assert q.count() == 2 and [(r.query_id, r.doc_id, r.pos) for r in gold.orderBy("pos").collect()] == [(1, "x", 1), (1, "y", 2), (1, "x", 3)]
    assert {r.key: r.value for r in files.read_json_map(spark, f"file://{tmp_path}/m.json", "string").collect()} == {"0": "d0", "1": "d1"}
    t = spark.createDataFrame([('["a","b"]',), ("",), (None,)], "j string").select(files.tokens_from_json("j").alias("t"))
    assert [r.t for r in t.collect()] == [["a", "b"], [], []]
    files.write_json(q, f"file://{tmp_path}/out", "query_id")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "k long, t string, x double")
    files.export_sqlite(df, f"{tmp_path}/t.db", "t")
    with sqlite3.connect(f"{tmp_path}/t.db") as con:
        assert con.execute("select * from t order by k").fetchall() == [(1, "a", 0.5), (2, None, 1.5)]
    assert files.import_sqlite(spark, f"{tmp_path}/t.db", "t", "k long, t string, x double").collect() == df.collect()
    with pytest.raises(ValueError):
        files.write_table(df.unionByName(df), "unused", "k", unique=True)


def test_corpus_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string")
    post = spark.createDataFrame([("x", 1), ("y", 2)], "token string, doc_id long")
    vectors = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>")
    files.write_corpus(docs, post, vectors, "t_", buckets=2)
    assert spark.table("t_inverted_index").join(spark.table("t_documents"), "doc_id").count() == 2 and spark.table("t_embeddings").count() == 1
    for t in ("documents", "inverted_index", "embeddings"):
        spark.sql(f"DROP TABLE t_{t}")
    stray = spark.createDataFrame([("x", 9)], "token string, doc_id long")
    blank = spark.createDataFrame([(None, 1)], "token string, doc_id long")
    for bad in ((docs.unionByName(docs), post, vectors), (docs, stray, vectors), (docs, blank, vectors), (docs, post, vectors.unionByName(vectors))):
        with pytest.raises(ValueError):
            files.write_corpus(*bad, "t_")


def test_static_files(tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.css").write_text("b{}")
    (tmp_path / "secret.txt").write_text("no")
    assert api.static_file(f"{tmp_path}/s", "/static/a.css") == ("text/css", b"b{}")
    for path in ("/static/none", "/static/../secret.txt", "/static/%2e%2e/secret.txt", "/static/"):
        assert api.static_file(f"{tmp_path}/s", path) is None


def test_open_windows_are_part_of_the_counts(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2024, 1, d, 12), "a", float(d)) for d in (1, 1, 2)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"file://{tmp_path}/ev")
    read = lambda: incremental.windowed(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"file://{tmp_path}/ev"))
    got = incremental.latest(read(), f"file://{tmp_path}/st", ("start", "event_type")).orderBy("start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 2.0), (1, 2.0)]
    spark.createDataFrame([(datetime(2024, 1, 2, 13), "a", 5.0)], "ts timestamp, event_type string, value double").write.mode("append").parquet(f"file://{tmp_path}/ev")
    got = incremental.latest(read(), f"file://{tmp_path}/st", ("start", "event_type")).orderBy("start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 2.0), (2, 7.0)]


def test_changed_files_are_read_again(spark, tmp_path):
    from lexloom.plans import catalog

    for n in (1, 2):
        spark.createDataFrame([(i, f"word{i} fox") for i in range(n)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        assert catalog.built(spark, f"file://{tmp_path}").n == n


def test_streams(spark, tmp_path):
    files_dir = tmp_path / "docs"
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    more = spark.createDataFrame([(3, "b c")], "doc_id long, text string")
    for batch in (docs, more):
        batch.coalesce(1).write.mode("append").parquet(f"file://{files_dir}")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"file://{files_dir}")
        incremental.index_stream(stream, f"file://{tmp_path}/ix").awaitTermination()
    assert {r.token: (r.n_t, r.tf) for r in incremental.statistics(spark, f"file://{tmp_path}/ix").collect()} == {"a": (1, 2), "b": (2, 2), "c": (1, 1)}


def test_storage(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = cut(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert cut(spark.createDataFrame([], "a int")).count() == 0
    bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_scratch_tables_go_with_the_application(spark):
    """cut() writes below the application's folder, which Spark's file system deletes when the application ends."""
    import os
    import subprocess
    import sys
    import tempfile

    from lexloom.storage import own_dir

    assert own_dir(spark).endswith(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="lexloom-shared-")
    code = (
        "from pyspark.sql import SparkSession; from lexloom.storage import cut; import os, sys;"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://' + sys.argv[1]).getOrCreate();"
        "cut(s.range(3)).count(); print(sum(x.startswith('lexloom-') for x in os.listdir(sys.argv[1]))); s.stop()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code, folder], capture_output=True, text=True, cwd=root, timeout=180)
    assert out.stdout.strip() == "1" and not [x for x in os.listdir(folder) if x.startswith("lexloom-")]
