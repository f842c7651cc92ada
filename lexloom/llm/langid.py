"""Language ID: multinomial naive Bayes over hashed character n-grams, scored sparsely in numpy.

Training counts the n-grams of a bounded hash sample of labelled rows on the executors; only one count vector per
language reaches the driver. Prediction is a narrow pass: the log-probability matrix is broadcast, and the n-grams of
a batch of texts, as a sparse matrix of texts by buckets, are multiplied with it at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches

from .memory import released

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Expected number of labelled rows to fit on, drawn by hash of the row's id; the one sample of this operator.
TRAIN_ROWS = 20_000
#: Languages at most: their log-probabilities, 128 KB each, are broadcast.
MAX_LANGUAGES = 2048
UNDETERMINED = "und"
#: Letters that are scored at once: those of many short texts, or a part of a long one.
_CHUNK = 1 << 18
_FACTORS = ((0x9E3779B1,), (0x85EBCA6B, 0xC2B2AE35), (0x27D4EB2F, 0x165667B1, 0xD3A2646D))
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as blank; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letter_table()[codes]
    return np.where(ok, codes, np.uint32(32)) if ok.any() else np.empty(0, np.uint32)


def buckets(codes: np.ndarray, order: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """The hash bucket of every n-gram of one order."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k, f in enumerate(_FACTORS[order - 1]):
        h += codes[k : k + n] * np.uint32(f)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def _counts(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    total: dict[str, list] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            codes = letters_of(text)
            if not len(codes):
                continue
            t = total.setdefault(lang, [0, np.zeros(1 << bits, np.int64)])
            t[0] += 1
            for at in range(0, len(codes), _CHUNK):
                for order in ORDERS:
                    t[1] += np.bincount(buckets(codes[at : at + _CHUNK + order - 1], order, bits), minlength=1 << bits)
    if total:
        rows = [(lang, n, zlib.compress(c.tobytes(), 1)) for lang, (n, c) in total.items()]
        yield pd.DataFrame(rows, columns=["lang", "n", "counts"])


def _summed(b: pd.DataFrame) -> pd.DataFrame:
    total = np.int64(0)
    for c in b["counts"]:
        total = total + np.frombuffer(zlib.decompress(c), np.int64)
    return pd.DataFrame({"lang": [b["lang"].iloc[0]], "n": [int(b["n"].sum())], "counts": [zlib.compress(total.tobytes(), 1)]})


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Model of labelled (doc_id, text, lang); rows without a language or a letter teach nothing.

    Deterministic: the sample is drawn by hash of doc_id at the rate rows / (number of labelled rows), counts are
    integers. Its size: one vector of 2^BUCKET_BITS floats per language. It is broadcast, so more than MAX_LANGUAGES
    are an error: there are fewer written languages with digital text than that.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.filter("lang is not null").select("doc_id", "text", "lang")
    n, langs = labelled.agg(F.count("*"), F.countDistinct("lang")).first()
    if langs > MAX_LANGUAGES:
        raise ValueError(f"{langs} languages; at most {MAX_LANGUAGES}")
    bits = BUCKET_BITS
    if n > rows:
        draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30))
        labelled = labelled.filter(draw < int(rows / n * (1 << 30)))
    schema = "lang string, n long, counts binary"
    parts = labelled.select("lang", "text").mapInPandas(lambda batches: _counts(batches, bits), schema)
    # two steps, so that no task gathers the vectors of more than a 64th of the tasks
    parts = parts.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = parts.groupBy("lang", "k").applyInPandas(lambda b: _summed(b), schema)
    found = once.groupBy("lang").applyInPandas(_summed, schema).orderBy("lang").collect()
    if not found:
        return {"langs": [], "logp": np.zeros((1 << bits, 0), np.float32), "prior": np.zeros(0)}
    counts = np.stack([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in found], axis=1) + SMOOTHING
    docs = np.array([r["n"] for r in found], float)
    return {
        "langs": [r["lang"] for r in found],
        "logp": np.ascontiguousarray(np.log(counts / counts.sum(axis=0)), np.float32),
        "prior": np.log(docs / docs.sum()),
    }


def _pieces(texts) -> Iterator[tuple[int, np.ndarray, int]]:
    """(text, letters, n-gram starts) of whole texts, long ones in pieces that overlap by an n-gram's length less one."""
    for i, text in enumerate(texts):
        codes = letters_of(text)
        for at in range(0, len(codes), _CHUNK):
            yield i, codes[at : at + _CHUNK + max(ORDERS) - 1], min(_CHUNK, len(codes) - at)


def scores(model: dict, texts) -> tuple[np.ndarray, np.ndarray]:
    """(sums of log-probabilities [texts, languages], whether a text has letters).

    N-grams of many texts are hashed together; those that would run over a text's end are left out. Each text's
    n-grams are the column indices of its row of a sparse matrix, and the product with the log-probability matrix is,
    language by language, a sum by segments of the entries that they name.
    """
    texts = list(texts)
    total = np.tile(model["prior"], (len(texts), 1))
    known = np.zeros(len(texts), bool)
    none = len(model["logp"])
    bits = none.bit_length() - 1
    if "columns" not in model:  # a contiguous column per language, and a bucket of weight 0
        model["columns"] = np.vstack([model["logp"], np.zeros((1, len(model["langs"])), np.float32)]).T.copy()

    def add(held: list) -> None:
        owner = np.array([i for i, _, _ in held])
        size = np.array([len(c) for _, c, _ in held])
        begins = np.array([n for _, _, n in held])
        known[owner] = True
        codes = np.concatenate([c for _, c, _ in held])
        start = np.cumsum(size) - size
        sums = np.zeros((len(held), len(model["langs"])))
        for order in ORDERS:
            got = np.full(len(codes), none, np.uint32)
            found = buckets(codes, order, bits)
            got[: len(found)] = found
            # n-grams that a text's end cuts, or that the next piece counts
            cut = start + np.minimum(begins, np.maximum(size - order + 1, 0))
            for d in range(2 * max(ORDERS)):
                at = cut + d
                got[at[at < start + size]] = none
            for x, column in enumerate(model["columns"]):
                sums[:, x] += np.add.reduceat(column.take(got), start, dtype=np.float64)
        np.add.at(total, owner, sums)

    held, letters = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        letters += len(piece[1])
        if letters >= _CHUNK:
            add(held)
            held, letters = [], 0
    if held:
        add(held)
    return total, known


def grams_in(text: str | None) -> int:
    """Number of n-grams that a text with letters is scored by."""
    n = len(text.lower()) if text else 0
    return sum(max(0, n - order + 1) for order in ORDERS)


def decided(model: dict, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, posterior probabilities, fits); 'und' and 0.0 for a text without letters or a model without languages.

    The posterior says which learned language is likeliest, however unlikely all are; the fit says whether it is likely:
    the mean over the n-grams of log(probability in that language / probability if all buckets were alike).
    """
    texts = list(texts)
    if not model["langs"]:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    total, known = scores(model, texts)
    best = total.argmax(axis=1)
    grams = np.array([grams_in(t) for t in texts], float)
    chance = -np.log(len(model["logp"]))
    likely = total[np.arange(len(texts)), best] - model["prior"][best]
    fit_ = np.where(known, likely / np.maximum(grams, 1) - chance, 0.0)
    posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True, initial=-np.inf)).sum(axis=1)
    return [model["langs"][x] if k else UNDETERMINED for x, k in zip(best, known)], np.where(known, posterior, 0.0), fit_


def score_text(model: dict, text: str | None) -> tuple[str, float]:
    """decided() of one text."""
    lang, score, _ = decided(model, [text])
    return lang[0], float(score[0])


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_fit (columns of these names are replaced); reads the text column only.

    Whole texts in chunks of bounded memory. Ties go to the smaller language. Repeated rows agree; an empty table
    gives an empty result; null or letterless text: 'und' with score and fit 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_fit")]

    @F.pandas_udf("lang_pred string, lang_score double, lang_fit double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        langs, score, fits = decided(sent.value, texts)
        released()
        return pd.DataFrame({"lang_pred": langs, "lang_score": score, "lang_fit": fits})

    out = docs.select(*rest, scored(F.col(text)).alias("__lang"))
    return out.select(*rest, *(F.col(f"__lang.{c}").alias(c) for c in ("lang_pred", "lang_score", "lang_fit")))


def held_out(doc_id):
    """crc32 of the id as text, mod 4, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
