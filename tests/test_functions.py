import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import stem, text, vectors

# Examples of the published algorithm, without later extensions.
PORTER = dict(
    caresses="caress", ponies="poni", ties="ti", caress="caress", cats="cat", feed="feed", agreed="agre", plastered="plaster", bled="bled",
    motoring="motor", sing="sing", conflated="conflat", troubled="troubl", sized="size", hopping="hop", tanned="tan", falling="fall",
    hissing="hiss", fizzed="fizz", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit",
    rational="ration", digitizer="digit", radicalli="radic", differentli="differ", vileli="vile", analogousli="analog", predication="predic",
    operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", callousness="callous", formaliti="formal",
    sensitiviti="sensit", sensibiliti="sensibl", triplicate="triplic", formative="form", formalize="formal", electrical="electr",
    hopeful="hope", goodness="good", revival="reviv", allowance="allow", inference="infer", airliner="airlin", adjustable="adjust",
    defensible="defens", irritant="irrit", replacement="replac", adjustment="adjust", dependent="depend", adoption="adopt",
    communism="commun", activate="activ", effective="effect", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll",
)


@pytest.mark.parametrize("word", PORTER)
def test_porter(word):
    assert stem.stem(word, extensions=False) == PORTER[word]


def test_stem_extensions():
    assert [stem.stem(w) for w in ("running", "ties", "dying", "flies", "spied")] == ["run", "tie", "die", "fli", "spi"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", max_size=20))
def test_stems_are_never_longer(word):
    assert len(stem.stem(word, False)) <= max(len(word), 1) + 1


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_tokens(spark):
    t = text.tokens(F.col("t"))
    assert one(spark, None, t) == [] and one(spark, "", t) == []
    assert one(spark, "Don't stop_it café _ 2²", t) == ["don", "t", "stop_it", "café", "2²"]


def test_stop_words(spark):
    assert one(spark, "the and or a an", text.content_tokens(F.col("t"))) == []
    assert one(spark, "The runner runs", text.content_tokens(F.col("t"))) == ["runner", "runs"]


def test_fields(spark):
    df = spark.createDataFrame([(" t ", None, "d\n")], "a string, b string, c string")
    r = df.select(text.weighted(*map(F.col, "abc")).alias("w"), text.weighted(*map(F.col, "abc"), null_text="nan").alias("n"), text.plain(*map(F.col, "abc")).alias("p"), text.present(*map(F.col, "abc")).alias("q")).first()
    assert (r.w, r.n, r.p, r.q) == ("t t t   d", "t t t nan nan d", "t d ", "t d")


def test_stem_vocabulary(spark):
    v = spark.createDataFrame([("running",), ("runs",), ("runs",), (None,)], "token string")
    assert {r.token: r.stem for r in text.stem_vocabulary(v).collect()} == {"running": "run", "runs": "run", None: None}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = df.select(vectors.normalized(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.to_bytes("a").alias("x")).collect()
    assert a.n == [0.6, 0.8] and a.c == pytest.approx(0.96) and b.n is None and b.c is None
    back = df.select(vectors.to_bytes("a").alias("embedding")).select(vectors.from_bytes().alias("v")).first().v
    assert np.allclose(back, [3, 4])
