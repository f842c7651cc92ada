"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to a in is for that it with was on by as this be are at from "
    "der die und den von zu das mit sich des auf für nicht ist im dem ein eine als "
    "de la le et les en un du que une est pour qui dans par sur au pas avec "
    "el y los se las del con por no una su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the ratio num / den must lie in [low, high]; None leaves an end open."""

    name: str
    num: str
    den: str
    low: float | None = None
    high: float | None = None


#: Compared as num >= low * den and num <= high * den, so a zero denominator passes.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_OWN = "__q_"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. grams: the windows' hashes in text order.

    A text without a repeated window is settled by a distinct count. Otherwise windows sort by hash with their
    position, neighbours of equal hash give the repeated positions, and a fold over these in text order counts
    the words covered.
    """
    tagged = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        flagged = F.transform(
            s,
            lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]),
        )
        return F.sort_array(F.array_compact(flagged))

    # one-element transform: binds the sorted array once, so that it is not computed again for each window
    found = F.transform(F.array(tagged), positions)[0]
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(grams) == F.size(F.array_distinct(grams)), F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_exclamations, n_stop_words, n_lines, n_dup_lines and n_repeat_words.

    All are long; a null text counts as empty. Columns of docs with these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumn(_OWN + "t", t).withColumn(_OWN + "w", F.regexp_extract_all(_OWN + "t", F.lit(WORD), F.lit(0)))
    words = F.col(_OWN + "w")
    grams = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    lines = F.filter(F.split(F.col(_OWN + "t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = staged.withColumns({_OWN + "g": grams, _OWN + "l": lines})
    t, words, lines = F.col(_OWN + "t"), F.col(_OWN + "w"), F.col(_OWN + "l")
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]")),
        "n_symbols": _removed(t, SYMBOLS),
        "n_exclamations": _removed(t, "!"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words, F.col(_OWN + "g")),
    }
    return staged.withColumns({k: v.cast("long") for k, v in out.items()}).drop(*(_OWN + x for x in "twgl"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean column over measures()."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.num) >= F.lit(r.low) * F.col(r.den))
        if r.high is not None:
            ok = ok & (F.col(r.num) <= F.lit(r.high) * F.col(r.den))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept.

    A narrow transformation: no shuffle, no Python, one row in memory at a time. Null and empty texts have zero
    measures and fail the word minimum. Every row is judged by its own text, so repeated rows agree; an empty
    table gives an empty result. Windows are compared by 64-bit hash within a text.
    """
    out = measures(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    parts = []
    for r in RULES:
        if r.low is not None:
            parts.append(f"{r.num} >= {r.low!r} * {r.den}")
        if r.high is not None:
            parts.append(f"{r.num} <= {r.high!r} * {r.den}")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    m AS (
      SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
        len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
      FROM w JOIN l ON w.doc_id = l.doc_id),
    p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
    g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM p),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
    s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r WHERE c > 1),
    n AS (SELECT doc_id, sum(least(3, i - coalesce(before, -2)))::BIGINT AS n FROM s GROUP BY doc_id),
    f AS (SELECT m.*, coalesce(n.n, 0) AS n_repeat_words FROM m LEFT JOIN n ON m.doc_id = n.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
      (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND {' AND '.join(parts)}) AS kept
    FROM f"""
