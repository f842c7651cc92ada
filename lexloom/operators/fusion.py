"""Reciprocal-rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.storage import cut

from .index import Index, spread
from .search import query_terms, top_k

RRF_K, CANDIDATES, RERANK = 10, 50, 20


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score: the sum of 1 / (k + rank) over ranked lists; union and one aggregation, no outer join."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))


def lexical_rerank(candidates: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """Rerank candidates(query_id, doc_id) by the share of the query's idf mass that the document's tokens cover.

    Only the candidates' postings are spread, and no text is read.
    """
    candidates = cut(candidates.select("query_id", "doc_id"), "candidates")
    terms = cut(query_terms(queries, index.stem).select("query_id", "token"), "query-terms").join(index.idf.select("token", "idf"), "token")
    terms = cut(terms, "query-weights")
    mass = terms.groupBy("query_id").agg(F.sum("idf").alias("mass"))
    wanted = candidates.join(terms, "query_id")
    tf = index.tf if index.forward is None else spread(index.rows.join(cut(candidates.select("doc_id").distinct(), "candidates"), "doc_id", "left_semi"))
    words = tf.select("token", "doc_id").join(wanted.select("token", "doc_id").distinct(), ["doc_id", "token"], "left_semi")
    met = wanted.join(words.withColumn("hit", F.lit(1)), ["doc_id", "token"], "left")
    covered = met.groupBy("query_id", "doc_id").agg(F.sum(F.when(F.col("hit") == 1, F.col("idf")).otherwise(0.0)).alias("covered"))
    scored = candidates.select("query_id", "doc_id").join(covered, ["query_id", "doc_id"], "left").join(mass, "query_id", "left")
    score = F.round(F.coalesce(F.try_divide("covered", "mass"), F.lit(0.0)), 6)
    return top_k(scored.select("query_id", "doc_id", score.alias("score")), k)


def rerank_pairs(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, query, text of candidates(query_id, doc_id): title, description and summary, those that are not
    empty; the id of a document that is unknown."""
    body = docs.select("doc_id", T.present(F.col("title"), F.col("description"), F.col("summary")).alias("text"))
    found = candidates.select("query_id", "doc_id").join(queries.select("query_id", "query"), "query_id").join(body, "doc_id", "left")
    return found.withColumn("text", F.coalesce("text", F.col("doc_id").cast("string")))


def model_rerank(candidates: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], k: int) -> DataFrame:
    """Rerank candidates(query_id, doc_id, query, text) by a scorer of (query, text) pairs, in Arrow batches."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(q, t))), dtype=float)

    return top_k(candidates.select("query_id", "doc_id", scored("query", "text").alias("score")), k)


def hybrid(sparse: DataFrame, dense: DataFrame, queries: DataFrame, index: Index, k: int = 5, rrf_k: int = RRF_K, rerank: int = RERANK) -> DataFrame:
    """Fuse two candidate lists, keep the best `rerank`, rerank those, return k: query_id, doc_id, score, rank."""
    return lexical_rerank(top_k(rrf(sparse, dense, k=rrf_k), rerank), queries, index, k)
