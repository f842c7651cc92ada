"""SQL functions: tokenize(text), cosine(a, b), stem(token), and the table function search(method, query, k)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.operators.index import EPSILON
from lexloom.operators.search import DIGITS, K1, B

from .stem import stem as stem_of
from .text import STOP_WORDS, TOKEN

#: Bodies in SQL, which Catalyst inlines: no Python runs for these.
TOKENIZE = f"""CREATE OR REPLACE TEMPORARY FUNCTION tokenize(text STRING) RETURNS ARRAY<STRING>
    RETURN filter(regexp_extract_all(lower(coalesce(text, '')), r'{TOKEN}', 0), t -> t <> '_')"""
COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
      / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"""


def register(spark: SparkSession, index: str | None = None) -> None:
    """The functions for this session; search() needs the folder of an index that sources.postings.save() wrote."""
    spark.sql(TOKENIZE)
    spark.sql(COSINE)

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem_of(w))

    spark.udf.register("stem", stem)
    if index is not None:
        spark.udtf.register("search", search_function(index))


def tokens_of(text: str) -> list[str]:
    """What tokenize() gives, without stop words, for one query in a worker."""
    return [w for w in re.findall(r"\w+", text.lower()) if w != "_" and w not in STOP_WORDS]


def search_function(index: str):
    """The table function over a saved index: one call reads the row groups of its query's tokens."""
    path = index.rstrip("/")

    class Search:
        """search(method, query, k): rank, doc_id, score of the k best documents; method is 'boolean' or 'bm25'.

        A null or empty query, or one of unknown words, has no rows; ties go to the smaller id.
        """

        def __init__(self):
            self.numbers = None

        def eval(self, method: str, query: str, k: int):
            from lexloom.sources import postings

            if method not in ("boolean", "bm25"):
                raise ValueError(f"unknown method {method!r}; known: boolean, bm25")
            if self.numbers is None:
                self.numbers = postings.small_table(f"{path}/numbers")[0]
            z = self.numbers
            asked = Counter(stem_of(w) if z["stem"] else w for w in tokens_of(query or ""))
            if not asked:
                return
            wanted, found = frozenset(asked), defaultdict(list)
            for file in postings.files_of(path, wanted):
                for b in postings.read_file(path, file, wanted, ["token", "doc_id", "f", "len"]):
                    words = b.column("token").dictionary_encode()
                    at, columns = words.indices.to_numpy(), [b.column(c).to_numpy() for c in ("doc_id", "f", "len")]
                    for i, token in enumerate(words.dictionary.to_pylist()):
                        own = at == i
                        found[token].append([c[own] for c in columns])
            ids, gains = [], []
            for token in asked:
                if token not in found:
                    continue
                m, (doc, f, size) = asked[token], (np.concatenate(c) for c in zip(*found.pop(token)))
                raw = math.log(z["n"] - len(doc) + 0.5) - math.log(len(doc) + 0.5)
                idf = raw if raw >= 0 else EPSILON * z["avg_idf"]
                ids.append(doc)
                gains.append(m * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / z["avgdl"])) if method == "bm25" else np.full(len(doc), float(m)))
            if not ids:
                return
            docs, place = np.unique(np.concatenate(ids), return_inverse=True)
            score = np.round(np.bincount(place, np.concatenate(gains)), DIGITS)
            if 0 < k < len(docs):  # only those that reach the k-th score are sorted
                reach = np.flatnonzero(score >= np.partition(score, -k)[-k])
                docs, score = docs[reach], score[reach]
            for i, at in enumerate(np.lexsort((docs, -score))[:k], 1):
                yield i, int(docs[at]), float(score[at])

    return F.udtf(Search, returnType="rank int, doc_id long, score double")
