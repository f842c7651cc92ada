"""Relations over token tables, against hand-made parses and a plain reading of the offline annotator."""

import pytest

from lexloom.operators import graph, syntax

SCHEMA = "doc_id long, sent int, i long, text string, lemma string, pos string, dep string, head long, name string"


def table(spark, *rows):
    """Rows (i, text, pos, dep, head, name) of document 1."""
    return spark.createDataFrame([(1, 0, i, t, t.lower(), pos, dep, head, name) for i, t, pos, dep, head, name in rows], SCHEMA)


def triples(df):
    return sorted((r.src, r.relation, r.dst) for r in df.collect())


#: Ada, Bruno and Carla met Dora in Norrvik
ACTIVE = (
    (0, "Ada", "PROPN", "nsubj", 5, "ada"), (1, "Bruno", "PROPN", "conj", 0, "bruno"), (3, "Carla", "PROPN", "conj", 1, "carla"), (5, "met", "VERB", "root", 5, None),
    (6, "Dora", "PROPN", "dobj", 5, "dora"), (7, "in", "ADP", "prep", 5, None), (8, "Norrvik", "PROPN", "pobj", 7, "norrvik"),
)


def test_clauses_follow_conjuncts_of_conjuncts(spark):
    got = triples(syntax.clause_relations(table(spark, *ACTIVE)))
    assert got == sorted([(s, r, o) for s in ("ada", "bruno", "carla") for r, o in (("met", "dora"), ("located_in", "norrvik"))])


def test_verbs_follow_direct_conjuncts_only(spark):
    got = triples(syntax.verb_relations(table(spark, *ACTIVE)))
    assert got == sorted([(s, "met", o) for s in ("ada", "bruno") for o in ("dora", "norrvik")])


def test_passive_subjects_are_objects(spark):
    t = table(spark, (0, "Ada", "PROPN", "nsubjpass", 1, "ada"), (1, "fought", "VERB", "root", 1, None), (2, "by", "ADP", "prep", 1, None), (3, "Bruno", "PROPN", "pobj", 2, "bruno"))
    assert triples(syntax.verb_relations(t)) == [("bruno", "attack", "ada")]
    assert triples(syntax.clause_relations(t)) == [("ada", "fought_by", "bruno")]


def test_stop_verbs(spark):
    t = table(spark, (0, "Ada", "PROPN", "nsubj", 1, "ada"), (1, "say", "VERB", "root", 1, None), (2, "Bruno", "PROPN", "dobj", 1, "bruno"))
    assert triples(syntax.clause_relations(t)) == [] == triples(syntax.verb_relations(t))
    assert triples(syntax.verb_relations(t, stop_first=False)) == [("ada", "communicate", "bruno")]


def test_pronouns_stand_for_the_last_names(spark):
    t = table(spark, (0, "She", "PRON", "nsubj", 1, None), (1, "met", "VERB", "root", 1, None), (2, "them", "PRON", "dobj", 1, None), (3, "x", "X", "root", 3, None))
    spans = spark.createDataFrame([(1, 0, "bruno", 2, 3)], "doc_id long, seq int, name string, start long, end long")
    ents = spark.createDataFrame([(1, "ada", "PERSON", 0)], "doc_id long, name string, label string, seq int")
    named = syntax.named(t, spans, graph.referents(ents))
    assert {r.i: r.name for r in named.collect()} == {0: "ada", 1: None, 2: "bruno", 3: None}
    assert triples(syntax.clause_relations(named)) == [("ada", "met", "bruno")]
    assert triples(syntax.clause_relations(syntax.named(t, spans))) == []
    other = syntax.named(t, spans.limit(0), graph.referents(ents))
    assert {r.i: r.name for r in other.collect()} == {0: "ada", 1: None, 2: "ada", 3: None}


def test_paths(spark):
    t = table(spark, *ACTIVE, (20, "Egon", "PROPN", "nsubj", 21, "egon"), (21, "left", "VERB", "root", 21, None))
    got = triples(syntax.path_relations(t))
    names = ("ada", "bruno", "carla", "dora", "norrvik")
    assert got == sorted((a, "met", b) for a in names for b in names if a != b)
    up = {(r.i, r.a): r.depth for r in syntax.ancestors(t).collect()}
    assert up[3, 5] == 3 and up[3, 0] == 2 and up[8, 5] == 2 and (8, 20) not in up and up[5, 5] == 0


def test_the_offline_annotator(spark):
    d = spark.createDataFrame([(1, "Ada meets Bruno and Carla in Norrvik. The rain fell. Egon and Dora left Vik"), (2, None), (3, "")], "doc_id long, text string")
    t = syntax.parsed(d)
    deps = {(r.text, r.dep) for r in t.filter("pos != 'X'").collect()}
    assert deps == {("Ada", "nsubj"), ("meets", "root"), ("Bruno", "dobj"), ("Carla", "conj"), ("in", "root"), ("Norrvik", "root"), ("Egon", "root"), ("Dora", "nsubj"), ("left", "root"), ("Vik", "dobj")}
    assert triples(syntax.clause_relations(t)) == [("ada", "meets", "bruno"), ("ada", "meets", "carla"), ("dora", "left", "vik")]
    assert {r.doc_id for r in t.collect()} == {1}


@pytest.mark.parametrize("f", [syntax.clause_relations, syntax.verb_relations, syntax.path_relations])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passives_are_found_in_the_order_of_words(spark):
    d = spark.createDataFrame([(1, "Ada was seen by Bruno. Carla is fought by Dora in Norrvik. Egon was near by Fritz? Gerd was kissed. Hans hit Ida."), (2, None)], "doc_id long, text string")
    tokens = syntax.with_passives(syntax.parsed(d))
    assert triples(syntax.verb_relations(tokens)) == [("bruno", "seen", "ada"), ("dora", "attack", "carla"), ("egon", "is", "fritz"), ("hans", "hit", "ida")]
    held = {r["text"]: (r["dep"], r["pos"]) for r in tokens.collect()}
    assert held["Ada"][0] == "nsubjpass" and held["seen"] == ("root", "VERB") and held["Bruno"][0] == "pobj" and held["Gerd"][0] == "nsubj"
    plain = syntax.parsed(d).count()
    assert tokens.count() == plain


def test_heads_without_a_shuffle(spark):
    """Passives made with the heads equal those made from the table; no window, no exchange; relations need no other words."""
    import random

    rng = random.Random(3)
    words = [*"Anna Bob Carl Dora was is eaten taken seen by in to and the quickly 7 The met".split(), "Anna was eaten by Bob", "Carl is seen by Dora and Anna"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 60))).replace(" 7", rng.choice([". ", " 7"]))) for i in range(150)] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    table = syntax.parsed(docs)
    analyzed = table._jdf.queryExecution().analyzed().toString()
    assert "Window" not in analyzed and "Aggregate" not in analyzed
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    passive = syntax.with_passives(table)
    assert passive.filter("dep = 'nsubjpass'").count() > 5
    assert rows(syntax.parsed(docs, passives=True)) == rows(passive)
    few = syntax.parsed(docs, others=False)
    assert rows(few) == rows(table.filter("pos != 'X'"))
    for relations in (syntax.clause_relations, syntax.path_relations):
        assert rows(relations(few)) == rows(relations(table)) != []
    assert rows(syntax.verb_relations(syntax.parsed(docs, passives=True, others=False))) == rows(syntax.verb_relations(passive))


def test_spans_meet_their_tokens_in_the_sentence(spark):
    """Only ids are shuffled; rows that share an id are one document, as the join of intervals has them."""
    from pyspark.sql import functions as F

    rows = [(1, "Anna met Berta in Paris yesterday. they slept. Then Carl saw Dora!"), (2, None), (3, ""), (4, "no names here."), (5, "Émile."), (None, "Anna met Berta.")]
    shared = [(7, "before Xaver went to Yvonne."), (7, "Zoe and then many more words. Late Name."), (7, "lower words only")]

    def joined(docs):
        t = syntax.parsed(docs)
        spans = t.filter("name is not null").groupBy("doc_id", F.col("sent").alias("seq")).agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.min_by("name", "i").alias("name"))
        return sorted((r["doc_id"], r["i"], r["name"]) for r in graph.span_tokens(t.select("doc_id", "i"), spans).filter("name is not null and doc_id is not null").collect())

    for each in (rows, rows + shared):
        docs = spark.createDataFrame(each, "doc_id long, text string")
        out = syntax.spanned(docs)
        assert sorted((r["doc_id"], r["i"], r["name"]) for r in out.select("doc_id", "i", "name").collect()) == joined(docs)
    plan = syntax.spanned(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [r["name"] for r in syntax.spanned(docs).filter("doc_id = 5").collect()] == ["émile"]
