"""Text normalisation as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem

#: Word characters as in Unicode-aware \w, for engines whose own \w is ASCII.
TOKEN = r"[\p{L}\p{N}_]+"

# The English stop-word list that is in common use for text retrieval.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her "
    "hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't".split()
)


def tokens(text: Column) -> Column:
    """Lower-case word tokens in order, duplicates kept; null and empty give an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: t != "_")


def content_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """tokens() without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*stop_words))


def terms(text: Column, stop_words: bool = True) -> Column:
    """Tokens of an index or a query: without stop words, or all of them."""
    return content_tokens(text) if stop_words else tokens(text)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def weighted(title: Column, summary: Column, description: Column, null_text: str = "") -> Column:
    """Title three times, summary twice, description once: the text of the inverted index and of embeddings.

    null_text="nan" writes missing fields as such text does where a table library turns them into strings.
    """
    t, s, d = (F.coalesce(strip(c), F.lit(null_text)) for c in (title, summary, description))
    return F.concat_ws(" ", t, t, t, s, s, d)


def plain(title: Column, summary: Column, description: Column) -> Column:
    """Title, description, summary: the text of BM25."""
    return F.concat_ws(" ", *(F.coalesce(strip(c), F.lit("")) for c in (title, description, summary)))


def present(*parts: Column) -> Column:
    """The non-empty parts joined by blanks."""
    return F.concat_ws(" ", *(F.nullif(strip(p), F.lit("")) for p in parts))


def stemmed(token: Column, extensions: bool = True) -> Column:
    """The stem of a token, for columns of few or distinct tokens."""
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w, extensions))

    return stems(token)


def stem_vocabulary(vocabulary, column: str = "token", extensions: bool = True):
    """vocabulary(token) with stem: Python runs once per distinct token, not per occurrence."""
    return vocabulary.select(column).distinct().withColumn("stem", stemmed(F.col(column), extensions))
