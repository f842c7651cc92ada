"""Positional postings: phrases by intersecting lists that are moved by their offsets, and reranking by proximity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.storage import cut

from .search import DIGITS, query_terms, top_k

#: What nearness adds to a score: ln(ALPHA + exp(-span / tokens matched)), after Tao and Zhai (2007).
ALPHA = 0.3


def postings(tokenized: DataFrame) -> DataFrame:
    """(token, doc_id, f, positions) of tokenized(doc_id, tokens), one row per document: the sorted positions, from 0.

    One shuffle, on (token, doc_id).
    """
    each = tokenized.select("doc_id", F.posexplode("tokens").alias("at", "token"))
    return each.groupBy("token", "doc_id").agg(F.count("*").alias("f"), F.array_sort(F.collect_list("at")).alias("positions"))


def phrases(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, doc_id, n, first: the documents that hold the tokens of queries(query_id, tokens) in a row.

    n is the number of places, first the first of them. index is that of postings(). The candidates are the documents
    of a query's rarest token, the first of equals; the other tokens' lists are read for those alone, by (token,
    doc_id), moved back by the token's offset, and a start that all offsets have in common is a match. Queries without
    tokens match nothing.
    """
    terms = cut(queries.select("query_id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "token")), "terms")
    often = index.join(terms.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n_t"))
    rarest = terms.join(often, "token", "left").groupBy("query_id").agg(F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("n_t", F.lit(0)), "offset")).alias("r"))
    rarest = rarest.select("query_id", "r.token", F.col("r.offset").alias("own"))
    starts = lambda positions, offset: F.filter(F.transform(positions, lambda p: p - offset), lambda p: p >= 0)
    found = rarest.join(index, "token").select("query_id", "doc_id", "own", starts(F.col("positions"), F.col("own")).alias("starts")).filter(F.size("starts") > 0)
    found = cut(found, "candidates")
    others = terms.join(found.select("query_id", "doc_id", "own"), "query_id").filter("offset != own").select("query_id", "doc_id", "token", "offset")
    moved = others.join(index, ["token", "doc_id"]).select("query_id", "doc_id", starts(F.col("positions"), F.col("offset")).alias("starts"))
    every = found.select("query_id", "doc_id", "starts").unionByName(moved)
    common = every.select("query_id", "doc_id", F.explode("starts").alias("start")).groupBy("query_id", "doc_id", "start").agg(F.count("*").alias("c"))
    size = terms.select("query_id", "size").distinct()
    return common.join(size, "query_id").filter("c = size").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first"))


def shortest(positions: list[np.ndarray]) -> int:
    """Length of the shortest stretch that holds a position of each list; the lists are sorted and not empty."""
    at = np.concatenate(positions)
    which = np.repeat(np.arange(len(positions)), [len(p) for p in positions])
    order = np.argsort(at, kind="stable")
    last, seen, best = [-1] * len(positions), 0, None
    for p, w in zip(at[order].tolist(), which[order].tolist()):
        seen += last[w] < 0
        last[w] = p
        if seen == len(positions):
            size = p - min(last) + 1
            best = size if best is None or size < best else best
    return best


def spans(candidates: DataFrame, queries: DataFrame, index: DataFrame, stem: bool = False) -> DataFrame:
    """query_id, doc_id, matched, span: how many distinct tokens of the query a candidate holds, and the shortest stretch
    of it that holds them all.

    Only the postings of the queries' tokens in their candidates are read; a group is one document and one query.
    """
    wanted = candidates.select("query_id", "doc_id").join(query_terms(queries, stem).select("query_id", "token"), "query_id")
    held = wanted.join(index.select("token", "doc_id", "positions"), ["token", "doc_id"])
    lists = held.groupBy("query_id", "doc_id").agg(F.collect_list("positions").alias("lists"))

    @F.pandas_udf("int")
    def span(found: pd.Series) -> pd.Series:
        return pd.Series([shortest([np.asarray(p) for p in lists]) for lists in found], dtype="int32")

    return lists.select("query_id", "doc_id", F.size("lists").alias("matched"), span("lists").alias("span"))


def proximity_rerank(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int, alpha: float = ALPHA, stem: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: candidates(query_id, doc_id, score) with what the nearness of the query's tokens adds.

    A candidate that holds no token keeps its score less the most that nearness can cost, ln(alpha).
    """
    near = spans(candidates, queries, index, stem)
    gain = F.log(F.lit(alpha) + F.coalesce(F.exp(-F.col("span") / F.col("matched")), F.lit(0.0)))
    scored = candidates.select("query_id", "doc_id", "score").join(near, ["query_id", "doc_id"], "left")
    return top_k(scored.select("query_id", "doc_id", F.round(F.col("score") + gain, DIGITS).alias("score")), k)
