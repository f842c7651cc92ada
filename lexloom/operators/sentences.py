"""Answers from the sentences of the best documents: walks on the graph of shared words, restarted by the question."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.storage import cut

CONTEXT_CHARS = 800
#: A sentence with its final stops, in the engine's and in Python's syntax alike.
SENTENCE = r"[^.!?\n]+[.!?]*"
#: Chance to follow a link, steps of the walk, sentences of an answer. Links after Mihalcea and Tarau (2004).
DAMPING, STEPS, ANSWER, DIGITS = 0.85, 10, 2, 9
#: A sentence's number is its document's rank times this, plus its place.
STRIDE = 10_000


def sentences(ranked: DataFrame, docs: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, s, sentence, words of the first `chars` characters of the documents of ranked(query_id, doc_id, rank).

    s orders a query's sentences; words are its distinct tokens without stop words.
    """
    found = ranked.select("query_id", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id")
    parts = F.regexp_extract_all(F.substring("text", 1, chars), F.lit(SENTENCE), F.lit(0))
    each = found.select("query_id", "rank", F.posexplode(parts).alias("at", "sentence"))
    each = each.select("query_id", (F.col("rank") * STRIDE + F.col("at")).cast("long").alias("s"), T.strip(F.col("sentence")).alias("sentence"))
    return each.filter("sentence != ''").withColumn("words", F.array_distinct(T.terms(F.col("sentence"))))


def links(found: DataFrame) -> DataFrame:
    """query_id, a, b, p: the chance of a step from a to b: shared words over the logarithms of both sizes, as a share of a's.

    Sentences of a query meet under their words.
    """
    each = found.select("query_id", "s", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = each.select("query_id", F.col("s").alias("b"), F.col("n").alias("m"), "word")
    met = each.join(other, ["query_id", "word"]).filter("s != b").groupBy("query_id", F.col("s").alias("a"), "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    weight = met.select("query_id", "a", "b", (F.col("shared") / (F.log(F.col("n") + 1.0) + F.log(F.col("m") + 1.0))).alias("w"))
    return weight.join(weight.groupBy("query_id", "a").agg(F.sum("w").alias("total")), ["query_id", "a"]).select("query_id", "a", "b", (F.col("w") / F.col("total")).alias("p"))


def ranked_sentences(found: DataFrame, queries: DataFrame, steps: int = STEPS) -> DataFrame:
    """query_id, s, sentence, score: where a walk of `steps` steps over links() is likely to be.

    It starts, and restarts, at sentences in proportion to one more than the words that they share with the question of
    queries(query_id, tokens).
    """
    found = cut(found, "sentences")
    asked = queries.select("query_id", F.array_distinct("tokens").alias("asked"))
    start = found.join(asked, "query_id").select("query_id", "s", (F.size(F.array_intersect("words", "asked")) + 1).alias("r"))
    start = cut(start.withColumn("r", F.col("r") / F.sum("r").over(Window.partitionBy("query_id"))), "start")
    way = cut(links(found), "links")
    now = start.select("query_id", "s", F.col("r").alias("score"))
    for _ in range(steps):
        moved = way.join(now.select("query_id", F.col("s").alias("a"), "score"), ["query_id", "a"])
        moved = moved.groupBy("query_id", F.col("b").alias("s")).agg(F.sum(F.col("p") * F.col("score")).alias("came"))
        now = start.join(moved, ["query_id", "s"], "left").select("query_id", "s", (F.lit(1 - DAMPING) * F.col("r") + F.lit(DAMPING) * F.coalesce("came", F.lit(0.0))).alias("score"))
    return now.join(found.select("query_id", "s", "sentence"), ["query_id", "s"]).select("query_id", "s", "sentence", F.round("score", DIGITS).alias("score"))


def answers(ranked: DataFrame, queries: DataFrame, docs: DataFrame, size: int = ANSWER) -> DataFrame:
    """query_id, n_docs, answer: the `size` best sentences in their order; ties go to the earlier one.

    ranked(query_id, doc_id, rank), queries(query_id, tokens), docs(doc_id, text). A query whose documents have no
    sentence has a null answer; one without documents has no row.
    """
    scored = ranked_sentences(sentences(ranked, docs), queries)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "s"))
    best = scored.withColumn("place", place).filter(F.col("place") <= size)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "sentence"))), lambda x: x["sentence"]), " ")
    n = ranked.groupBy("query_id").agg(F.count("*").alias("n_docs"))
    return n.join(best.groupBy("query_id").agg(text.alias("answer")), "query_id", "left")


@dataclass
class Extractive:
    """answers() for one question and the context of one request, without Spark: a few dozen sentences at most."""

    sentences: int = ANSWER

    def available(self) -> bool:
        return True

    def __call__(self, query: str, text: str) -> str | None:
        tokens = lambda t: [w for w in re.findall(r"\w+", t.lower()) if w != "_" and w not in T.STOP_WORDS]
        parts = [re.sub(r"^Document \d+: ", "", p) for p in text.split("\n---\n")]
        found = [s.strip() for p in parts for s in re.findall(SENTENCE, p) if s.strip()]
        words, asked = [set(tokens(s)) for s in found], set(tokens(query))
        r = [1 + len(w & asked) for w in words]
        r = [x / sum(r) for x in r]
        size = [math.log(len(w) + 1.0) for w in words]
        w = [[len(a & b) / (size[i] + size[j]) if i != j and a & b else 0.0 for j, b in enumerate(words)] for i, a in enumerate(words)]
        total, score = [sum(x) for x in w], r
        for _ in range(STEPS):
            score = [(1 - DAMPING) * r[j] + DAMPING * sum(score[i] * w[i][j] / total[i] for i in range(len(found)) if w[i][j]) for j in range(len(found))]
        best = sorted(range(len(found)), key=lambda i: (-round(score[i], DIGITS), i))[: self.sentences]
        return " ".join(found[i] for i in sorted(best)) or None


def oracle(ranked: str, steps: int = STEPS, size: int = ANSWER) -> str:
    """DuckDB CTEs of answers(): ranked names a table (query_id, doc_id, rank), q(query_id, toks) is there."""
    out = rf"""sx AS (SELECT query_id, rank, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS place FROM (SELECT query_id, rank, regexp_extract_all(substr(d.text, 1, {CONTEXT_CHARS}), '{SENTENCE}') AS ss FROM {ranked} r JOIN documents d ON r.doc_id = d.doc_id)),
    sy AS (SELECT query_id, (rank * {STRIDE} + place)::BIGINT AS s, regexp_replace(regexp_replace(sentence, '^\s+', ''), '\s+$', '') AS sentence FROM sx),
    sz AS MATERIALIZED (SELECT query_id, s, sentence, list_distinct({{words}}) AS words FROM sy WHERE sentence <> ''),
    sr AS (SELECT query_id, s, len(list_intersect(words, toks)) + 1 AS r FROM sz JOIN q USING (query_id)),
    s0 AS MATERIALIZED (SELECT query_id, s, r / sum(r) OVER (PARTITION BY query_id) AS r, r / sum(r) OVER (PARTITION BY query_id) AS score FROM sr),
    se AS (SELECT query_id, s, len(words) AS n, unnest(words) AS word FROM sz),
    sw AS (SELECT x.query_id, x.s AS a, y.s AS b, count(*) / (ln(any_value(x.n) + 1.0::DOUBLE) + ln(any_value(y.n) + 1.0::DOUBLE)) AS w FROM se x JOIN se y ON x.query_id = y.query_id AND x.word = y.word AND x.s <> y.s GROUP BY x.query_id, x.s, y.s),
    sp AS MATERIALIZED (SELECT query_id, a, b, w / sum(w) OVER (PARTITION BY query_id, a) AS p FROM sw)"""
    for i in range(steps):
        out += f""",
    s{i + 1} AS MATERIALIZED (SELECT z.query_id, z.s, z.r, {1 - DAMPING}::DOUBLE * z.r + {DAMPING}::DOUBLE * coalesce(came, 0) AS score
      FROM s{i} z LEFT JOIN (SELECT sp.query_id, b AS s, sum(p * score) AS came FROM sp JOIN s{i} x ON x.query_id = sp.query_id AND x.s = sp.a GROUP BY sp.query_id, b) m ON m.query_id = z.query_id AND m.s = z.s)"""
    return out + f""",
    sb AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {DIGITS}) DESC, s) AS place FROM s{steps}),
    sa AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY s) AS answer FROM sb JOIN sz USING (query_id, s) WHERE place <= {size} GROUP BY query_id)"""
