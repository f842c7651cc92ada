"""Corpus preparation: filters, keys, merges and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exclude(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is not listed; null is not listed. Values compare as strings, so 11 and '11' agree."""
    c = F.col(column).cast("string")
    return df.filter(c.isNull() | ~c.isin(*map(str, values)))


def within(df: DataFrame, season: int, last: int) -> DataFrame:
    """The documents of one season up to a number: a slice of the corpus for a small graph."""
    return df.filter((F.col("season") == season) & (F.col("number") <= last))


def document_key(season: Column, number: Column) -> Column:
    """'{season}x{number}'; null if either is null."""
    return F.concat(season.cast("string"), F.lit("x"), number.cast("string"))


def dedup_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key by sequence, ties by the whole row: a partial aggregate, not a window, so a hot key is reduced before its shuffle."""
    last = F.max_by(F.struct(*df.columns), F.struct(sequence, *df.columns))
    return df.groupBy(F.col(key).alias("__key")).agg(last.alias("__row")).select("__row.*")


def merge_left(base: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Left joins on one key; a key that repeats on the right fans out."""
    for other in others:
        base = base.join(other, on, "left")
    return base


def quarantine(df: DataFrame, *casts: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns cast to the types, the rows that do not)."""
    tried = {f"__{c}": F.expr(f"try_cast({c} AS {t})") for c, t in casts}
    out = df.withColumns(tried)
    ok = F.lit(True)
    for c, _ in casts:
        ok = ok & F.col(f"__{c}").isNotNull()
    good = out.filter(ok).withColumns({c: F.col(f"__{c}") for c, _ in casts}).drop(*tried)
    return good, out.filter(~ok).drop(*tried)


def enrich(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """ranked(query_id, rank, doc_id) with docs' season, number, title, description; unknown ids get placeholders."""
    known = docs.select("doc_id", "season", "number", "title", "description")
    out = ranked.join(known, "doc_id", "left")
    return out.select(
        "query_id", "rank", "doc_id", F.coalesce("season", F.lit(0)).alias("season"), F.coalesce("number", F.lit(0).cast("long")).alias("number"),
        F.coalesce("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("title"),
        F.coalesce("description", F.lit("No metadata for this document.")).alias("description"),
    )
