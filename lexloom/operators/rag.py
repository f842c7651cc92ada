"""Retrieval-augmented answers: context, prompt, generator and report, with an offline extractive generator."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

from .sentences import Extractive
from .sentences import answers as extracted

CONTEXT_DOCS, CONTEXT_CHARS, TITLE_CHARS = 5, 800, 100
RETRIEVAL_FAILED = "Documents could not be retrieved."
PROMPT = """Use only the passages below to answer. If they do not hold the answer, say that you do not know.
Name the passages you rely on by their numbers.

Passages:
{context}

Question: {query}

Answer:"""


def context(ranked: DataFrame, docs: DataFrame, content: str = "text") -> DataFrame:
    """query_id, n_docs, context: 'Document i: text' of the ranked documents in order; content='id' gives ids instead of texts."""
    body = F.coalesce("text", F.col("doc_id").cast("string")) if content == "text" else F.col("doc_id").cast("string")
    one = ranked.join(docs.select("doc_id", "text"), "doc_id", "left").select(
        "query_id", "rank", F.concat(F.lit("Document "), F.col("rank").cast("string"), F.lit(": "), F.substring(body, 1, CONTEXT_CHARS), F.lit("\n")).alias("part")
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return one.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.array_join(F.transform(parts, lambda x: x["part"]), "\n---\n").alias("context"))


def prompt(query: str, text: str) -> str:
    return PROMPT.format(context=text, query=query)


@dataclass
class HttpModel:
    """A local model server with a generate endpoint; answers None on any failure."""

    url: str
    model: str
    temperature: float = 0.7
    max_tokens: int = 500
    timeout: float = 90.0
    probe_timeout: float = 2.0

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(self.url, timeout=self.probe_timeout) as r:
                return r.status == 200
        except OSError:
            return False

    def __call__(self, query: str, text: str) -> str | None:
        body = {"model": self.model, "prompt": prompt(query, text), "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.loads(r.read()).get("response") or None
        except (OSError, ValueError):
            return None


@dataclass
class Answer:
    query: str
    retrieved_docs: list[dict] = field(default_factory=list)
    context: str = ""
    answer: str | None = None
    error: str | None = None
    source: str = ""

    @property
    def has_answer(self) -> bool:
        return bool(self.answer and not self.error)


def answer(query: str, retrieve: Callable[[str], list[tuple[int, str]]], generator=None) -> Answer:
    """retrieve(query) gives (doc_id, text), best first. Failures come back in error, never as exceptions."""
    generator = generator or Extractive()
    out = Answer(query, source=type(generator).__name__)
    if not query or not query.strip():
        out.error = "The query is empty."
        return out
    if not generator.available():
        out.error = "The generator is not available."
        return out
    try:
        found = retrieve(query)[:CONTEXT_DOCS]
    except Exception as e:  # noqa: BLE001
        out.error = f"{RETRIEVAL_FAILED} {e}"
        return out
    out.retrieved_docs = [{"doc_id": d, "title": (t or "")[:TITLE_CHARS], "score": 1.0} for d, t in found]
    out.context = "\n---\n".join(f"Document {i}: {(t or '')[:CONTEXT_CHARS]}\n" for i, (_, t) in enumerate(found, 1))
    if not found:
        out.error = "No documents match."
        return out
    out.answer = generator(query, out.context)
    if out.answer is None:
        out.error = "The generator gave no answer."
    return out


def report(a: Answer) -> str:
    lines = [f"Query: {a.query}", f"Source: {a.source}", "", f"Answer: {a.answer}" if a.has_answer else f"Error: {a.error}", "", "Documents:"]
    return "\n".join(lines + [f"  {i}. [{d['doc_id']}] {d['title']}" for i, d in enumerate(a.retrieved_docs, 1)])


def answers(ranked: DataFrame, queries: DataFrame, docs: DataFrame, generator=None) -> DataFrame:
    """query_id, n_docs, answer, source for a batch of queries(query_id, query): contexts and answers on the executors.

    Without a generator the answers are sentences of the documents, ranked by joins; a generator, such as a model's
    client, is called in Arrow batches.
    """
    if generator is None:
        asked = queries.select("query_id", T.terms(F.col("query")).alias("tokens"))
        return extracted(ranked, asked, docs).withColumn("source", F.lit(Extractive.__name__))

    @F.pandas_udf("string")
    def generated(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([generator(a, b) for a, b in zip(q, c)], dtype=object)

    out = context(ranked, docs).join(queries.select("query_id", "query"), "query_id")
    return out.select("query_id", "n_docs", generated("query", "context").alias("answer"), F.lit(type(generator).__name__).alias("source"))
