import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import langid

WORDS = {"en": "the of and to in is that with for", "de": "der die und das mit nicht ist ein für", "fr": "le la les des est dans pour avec où"}
SCHEMA = "doc_id long, text string, lang string, extra string, lang_pred string"


def rows():
    out = []
    for i in range(90):
        lang = list(WORDS)[i % 3]
        w = WORDS[lang].split()
        out.append((i, " ".join(w[(i + j) % len(w)] for j in range(12)), lang, "x", "clash"))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(rows(), SCHEMA))


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.query(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id")
    ok, n = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and ok > 0.97


def test_held_out_is_crc32_of_the_id(spark):
    got = {r.doc_id: r.h for r in spark.range(200).select(F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_edges(spark, model):
    docs = spark.createDataFrame([(1, None, None, "a", "b"), (2, "", None, "a", "b"), (3, "12 !!", None, "a", "b"), (None, "der die und das", None, "a", "b"), (4, "the of and " * 40_000, "de", "a", "b"), (4, "the of and " * 40_000, "de", "a", "b")], SCHEMA)
    got = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de", "en", "en"]
    assert all(0 <= r.lang_score <= 1 for r in got) and got[0].extra == "a"


def test_prediction_reads_the_text_only(spark, model):
    docs = spark.createDataFrame(rows(), SCHEMA)
    changed = docs.withColumn("lang", F.lit("fr")).withColumn("doc_id", -F.col("doc_id"))
    a, b = (langid.predict(d, model).select("text", "lang_pred", "lang_score").distinct().orderBy("text").collect() for d in (docs, changed))
    assert a == b


def test_empty_tables(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty)
    assert none["langs"] == [] and langid.score_text(none, "the") == ("und", 0.0)


def test_scores_match_a_plain_computation(spark, model):
    text = "der Die où"
    codes = langid.letters_of(text)
    total = model["prior"].copy()
    for order in langid.ORDERS:
        for b in langid.buckets(codes, order):
            total = total + model["logp"][b]
    assert langid.score_text(model, text)[0] == model["langs"][int(total.argmax())]


def plain_grams(text):
    """Bucket numbers of all n-grams, by Python's integers."""
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not clean.strip():
        return []
    out, word = [], (1 << 32) - 1
    for factors in langid._FACTORS:
        for i in range(len(clean) - len(factors) + 1):
            h = sum(ord(c) * f for c, f in zip(clean[i:], factors)) & word
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D & word) >> 17)
    return out


def test_fit_and_scores_equal_a_plain_naive_bayes(spark):
    """Training and prediction of a table recomputed with counters and sums of logarithms."""
    import math
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    grams = {i: Counter(plain_grams(t)) for i, t, _ in docs}
    counts, rows = {}, Counter()
    for i, t, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 and grams[i]:
            rows[lang] += 1
            counts.setdefault(lang, Counter()).update(grams[i])
    size = 1 << 15
    total = {x: sum(c.values()) + 0.5 * size for x, c in counts.items()}
    got = {r.doc_id: r for r in langid.query(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        if not grams[i]:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        value = {x: math.log(rows[x] / sum(rows.values())) + sum(n * math.log((counts[x][g] + 0.5) / total[x]) for g, n in grams[i].items()) for x in counts}
        best = max(sorted(value), key=value.get)
        posterior = 1 / sum(math.exp(v - value[best]) for v in value.values())
        assert got[i].lang_pred == best and got[i].score == pytest.approx(posterior, abs=1e-2)


def test_batches_equal_single_texts(model, monkeypatch):
    texts = ["der die das", None, "", "x", "où est le", "1 2", "the of " * 500, "à", "and in is that" * 40]
    whole = [langid.score_text(model, t) for t in texts]
    for chunk in (1 << 18, 7, 64):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        langs, score, _ = langid.decided(model, texts)
        assert langs == [x for x, _ in whole] and score == pytest.approx([s for _, s in whole])


def test_languages_are_bounded_and_the_hash_space_is_not(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert langid.fit(docs)["logp"].shape == (1 << langid.BUCKET_BITS, 3)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="3 languages; at most 2"):
        langid.fit(docs)


def test_training_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame(rows() * 3, SCHEMA)
    a, b = langid.fit(docs, rows=60), langid.fit(docs.repartition(5), rows=60)
    assert a["langs"] == b["langs"] and (a["logp"] == b["logp"]).all()


def test_fit_tells_learned_languages_from_others(spark):
    """The lowest fit of any document of the learned languages is above chance; another script and noise are below."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d)
    got = langid.predict(d, model).filter("lang_pred != 'und'")
    assert got.agg(F.min("lang_fit")).first()[0] > 0
    other = ["Это обычный текст на другом языке и с другими буквами", "这是另一种语言的普通文本没有学过", "ξζ ψω χφ ϟϡ ϖϱ"]
    assert all(fit < 0 for fit in langid.decided(model, other)[2])


def test_fit_is_the_mean_log_ratio(spark, model):
    for text in ("der Die où", "the", "a" * 500_000):
        lang, _, fits = langid.decided(model, [text])
        x, grams = model["langs"].index(lang[0]), plain_grams(text) if len(text) < 100 else [b for o in langid.ORDERS for b in langid.buckets(langid.letters_of(text), o)]
        want = sum(float(model["logp"][g, x]) for g in grams) / len(grams) + 15 * 0.6931471805599453
        assert abs(fits[0] - want) < 1e-4 and langid.grams_in(text) == len(grams)
