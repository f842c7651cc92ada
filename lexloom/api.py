"""Search and answers for single requests: validation, routing, enrichment, and a small HTTP service."""

from __future__ import annotations

import json
import mimetypes
import os
import urllib.parse
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus, fusion, index, rag, search, vector
from lexloom.storage import cut

METHODS = {"boolean": "Boolean", "bm25": "BM25", "semantic": "Semantic", "ann": "ANN", "fused": "Fused"}
SPEEDS = {"boolean": "very fast", "bm25": "fast", "semantic": "medium", "ann": "fast", "fused": "slow", "rag": "slowest"}
MIN_QUERY = 2


def validated(query: str | None, method: str = "boolean") -> str:
    """The trimmed query; ValueError says what is wrong with a request."""
    query = (query or "").strip()
    if not query:
        raise ValueError("query is empty")
    if len(query) < MIN_QUERY:
        raise ValueError(f"query is shorter than {MIN_QUERY} characters")
    if method == "rag":
        raise ValueError("use rag() for answers")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    return query


@dataclass
class Engine:
    """A corpus ready for search: docs(doc_id, season, number, title, summary, description), its index and vectors.

    Owns its tables; nothing is cached globally.
    """

    spark: SparkSession
    docs: DataFrame
    lexical: index.Index
    postings: DataFrame
    vectors: DataFrame
    near: vector.LshIndex
    dim: int = 64
    query_prefix: str = vector.QUERY_PREFIX
    stop_words: bool = True

    @classmethod
    def build(cls, docs: DataFrame, dim: int = 64, query_prefix: str = vector.QUERY_PREFIX, stop_words: bool = True, stem: bool = True) -> Engine:
        """stop_words leaves stop words out of the index and of queries; stem indexes stems. Each can be turned off.

        The inverted index and the vectors are of the weighted text, BM25 of the plain one.
        """
        fields = [F.col(c) for c in ("title", "summary", "description")]
        lexical = index.build(docs.select("doc_id", T.terms(T.plain(*fields), stop_words).alias("tokens")), stem)
        weighted = index.build(docs.select("doc_id", T.terms(T.weighted(*fields), stop_words).alias("tokens")), stem)
        vectors = cut(vector.embed(weighted.tf, lexical.idf, "doc_id", dim), "vectors")
        near = vector.LshIndex.build(vectors, dim)
        return cls(docs.sparkSession, docs, lexical, weighted.tf.select("token", "doc_id"), vectors, near, dim, query_prefix, stop_words)

    def save(self, path: str) -> None:
        """Documents, indexes and vectors as tables below path, for load()."""
        self.docs.write.mode("overwrite").parquet(f"{path}/documents")
        self.lexical.save(f"{path}/lexical")
        self.postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/inverted_index")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.near.save(f"{path}/near")
        row = [(self.dim, self.query_prefix, self.stop_words)]
        self.spark.createDataFrame(row, "dim int, query_prefix string, stop_words boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        docs, postings, vectors, settings = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "inverted_index", "vectors", "settings"))
        return cls(spark, docs, index.Index.load(spark, f"{path}/lexical"), postings, vectors, vector.LshIndex.load(spark, f"{path}/near"), *settings.first())

    def asked(self, queries: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        return rows.withColumn("tokens", T.terms(F.col("query"), self.stop_words))

    def ranked(self, queries: list[str], method: str, k: int = 5) -> DataFrame:
        """query_id, doc_id, score, rank for a batch of queries."""
        q = self.asked(queries)
        if method == "boolean":
            return search.overlap(q, self.postings, k, self.lexical.stem)
        if method == "bm25":
            return search.bm25(q, self.lexical, k)
        if method in ("semantic", "ann"):
            text = F.concat(F.lit(self.query_prefix if method == "ann" else ""), F.col("query"))
            terms = search.query_terms(q.withColumn("tokens", T.terms(text, self.stop_words)), self.lexical.stem).withColumnRenamed("m", "f")
            asked = vector.embed(terms, self.lexical.idf, "query_id", self.dim)
            return vector.cosine(asked, self.vectors, k) if method == "semantic" else self.near.search(asked, k)
        if method == "fused":
            sparse, dense = (self.ranked(queries, m, fusion.CANDIDATES) for m in ("bm25", "semantic"))
            return fusion.hybrid(sparse, dense, q, self.lexical, k)
        raise ValueError(f"unknown method {method!r}")

    def search(self, query: str, method: str = "boolean", k: int = 5) -> list[dict]:
        """Enriched records, best first."""
        found = corpus.enrich(self.ranked([validated(query, method)], method, k), self.docs).orderBy("rank")
        return [r.asDict() for r in found.drop("query_id").collect()]

    def rag(self, query: str, generator=None, method: str = "fused") -> rag.Answer:
        def retrieve(q: str) -> list[tuple[int, str]]:
            return [(r["doc_id"], r["description"]) for r in self.search(q, method, rag.CONTEXT_DOCS)]

        try:
            query = validated(query, method)
        except ValueError as e:
            return rag.Answer(query or "", error=str(e))
        return rag.answer(query, retrieve, generator)


def catalog() -> list[dict]:
    return [{"id": m, "name": METHODS.get(m, "RAG"), "speed": s} for m, s in SPEEDS.items()]


def handle(engine: Engine, verb: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """(status, JSON) of a request: GET /api/methods, POST /api/search, POST /api/rag."""
    try:
        if (verb, path) == ("GET", "/api/methods"):
            return 200, {"methods": catalog()}
        if verb == "POST" and path in ("/api/search", "/api/rag"):
            asked = json.loads(body or b"{}")
            if path == "/api/rag":
                out = engine.rag(asked.get("query"))
                return (200 if not out.error else 400 if not out.source else 503), asdict(out) | {"has_answer": out.has_answer}
            method = asked.get("method", "boolean")
            return 200, {"query": asked.get("query"), "method": method, "results": engine.search(asked.get("query"), method, int(asked.get("k", 5)))}
        return 404, {"error": "not found"}
    except ValueError as e:
        return 400, {"error": str(e)}
    except Exception as e:  # noqa: BLE001
        return 500, {"error": str(e)[:500]}


PAGE = (
    "<!DOCTYPE html><meta charset=utf-8><title>Search</title><input id=q><select id=m></select><button id=b>Search</button><ol id=o></ol><script>"
    "const $=i=>document.getElementById(i);fetch('/api/methods').then(r=>r.json()).then(d=>d.methods.filter(m=>m.id!=='rag').forEach(m=>{"
    "const o=document.createElement('option');o.value=m.id;o.textContent=m.name+' ('+m.speed+')';$('m').append(o)}));"
    "$('b').onclick=()=>fetch('/api/search',{method:'POST',body:JSON.stringify({query:$('q').value,method:$('m').value})}).then(r=>r.json()).then(d=>{"
    "$('o').textContent=d.error||'';(d.results||[]).forEach(r=>{const l=document.createElement('li');l.textContent=r.title+': '+r.description.slice(0,300);$('o').append(l)})})</script>"
)


def static_file(folder: str, path: str) -> tuple[str, bytes] | None:
    """(content type, bytes) of a file below folder for a request path /static/..., None if there is none."""
    base = os.path.realpath(folder)
    wanted = os.path.realpath(os.path.join(base, urllib.parse.unquote(path.removeprefix("/static/").split("?")[0])))
    if not wanted.startswith(base + os.sep) or not os.path.isfile(wanted):
        return None
    with open(wanted, "rb") as f:
        return mimetypes.guess_type(wanted)[0] or "application/octet-stream", f.read()


def serve(engine: Engine, port: int = 5001, static: str | None = None) -> ThreadingHTTPServer:
    """A server to run with serve_forever(); static is a folder whose files are served below /static/."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, kind: str, data: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            if self.path == "/":
                return self._reply(200, "text/html; charset=utf-8", PAGE.encode())
            if static and self.path.startswith("/static/"):
                found = static_file(static, self.path)
                return self._reply(200, *found) if found else self._reply(404, "text/plain", b"not found")
            status, out = handle(engine, "GET", self.path)
            self._reply(status, "application/json", json.dumps(out, default=str).encode())

        def do_POST(self):  # noqa: N802
            status, out = handle(engine, "POST", self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self._reply(status, "application/json", json.dumps(out, default=str).encode())

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
