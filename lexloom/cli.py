"""Command line: python -m lexloom.cli --mode eval|build|search|rag|serve --data FOLDER [...]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lexloom.api import METHODS, Engine, serve
from lexloom.operators import corpus, evaluate, rag, search
from lexloom.plans import catalog
from lexloom.session import local_session, ship
from lexloom.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    p.add_argument("--mode", choices=("eval", "build", "search", "rag", "serve"), default="eval")
    p.add_argument("--data", help="folder with documents.parquet and benchmark.parquet")
    p.add_argument("--index", help="folder of a built index: written by build, read by search, rag and serve")
    p.add_argument("--keep-stop-words", action="store_true", help="index and ask stop words, too")
    p.add_argument("--no-stems", action="store_true", help="index and ask tokens as they are written")
    p.add_argument("--exclude", nargs="+", default=[], help="seasons that are left out of the corpus")
    p.add_argument("--static", help="with serve: a folder whose files are served below /static/")
    p.add_argument("--query")
    p.add_argument("--search-method", choices=tuple(METHODS), default="boolean")
    p.add_argument("--sweep-bm25", action="store_true", help="with eval: a grid of k1 and b instead of the methods")
    p.add_argument("--k1-values", type=float, nargs="+", default=list(catalog.K1_GRID))
    p.add_argument("--b-values", type=float, nargs="+", default=list(catalog.B_GRID))
    p.add_argument("--output", help="folder for the results as CSV")
    p.add_argument("--port", type=int, default=5001)
    p.add_argument("--cpus", default="*")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.mode in ("search", "rag") and not (a.query or "").strip():
        parser().error("--query is needed")
    if not a.data and not (a.index and a.mode in ("search", "rag", "serve")):
        parser().error("--data is needed")
    if a.mode == "build" and not a.index:
        parser().error("--index is needed")
    spark = spark or local_session(a.cpus)
    ship(spark)
    if a.mode == "eval":
        if a.sweep_bm25:
            q = catalog.asked(spark, a.data)
            grid = [(k1, b) for k1 in a.k1_values for b in a.b_values]
            found = search.bm25_sweep(q, catalog.built(spark, a.data), grid)
            each = F.explode(F.array(*(F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b")) for k1, b in grid)))
            keys = q.select("query_id", each.alias("g")).select("g.k1", "g.b", "query_id")
            out = evaluate.macro_means(evaluate.metrics(found, catalog.gold_of(spark, a.data), keys, group=("k1", "b")), "k1", "b").orderBy("k1", "b")
        else:
            out = evaluate.ranking(evaluate.macro_means(catalog.scored_methods(spark, a.data))).orderBy("rank")
        if a.output:
            files.write_csv(out, a.output)
        out.show(100, truncate=False)
        return 0
    if a.index and a.mode != "build":
        engine = Engine.load(spark, a.index)
    else:
        docs = corpus.exclude(catalog.documents(spark, a.data), "season", a.exclude)
        engine = Engine.build(docs, stop_words=not a.keep_stop_words, stem=not a.no_stems)
    if a.mode == "build":
        engine.save(a.index)
        print(f"{a.index}: {engine.lexical.n} documents, {engine.lexical.idf.count()} tokens, recall {engine.near.measured:.3f} of the vector index on its sample")
    elif a.mode == "serve":
        serve(engine, a.port, a.static).serve_forever()
    elif a.mode == "rag":
        print(rag.report(engine.rag(a.query)))
    else:
        for r in engine.search(a.query, a.search_method):
            print(f"{r['rank']}. [{r['doc_id']}] {r['title'][:100]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
