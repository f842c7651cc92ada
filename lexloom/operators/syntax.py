"""Relations over an annotator's token table, by joins: tokens(doc_id, sent, i, text, lemma, pos, dep, head, name).

i numbers the tokens of a document, head is the i of a token's head (its own for a root), name is the entity at the
token or null. Any parser can fill the table; parsed() is the offline one. Each join is by equality on (doc_id, i).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.graph import ENTITY_STOP, PREPOSITIONS, SENTENCE_END, SENTENCE_STARTS, VERB_STOP, _looked_up, relation_of, span_tokens
from lexloom.storage import bounded_batches, cut

# Pronouns that stand for the last person, and for the last person or else the last organization.
PERSON_PRONOUNS = ("he", "she", "him", "her", "his", "hers")
OTHER_PRONOUNS = ("they", "them", "it")
# Dependencies of subjects and objects.
SUBJECTS, PASSIVE = ("nsubj", "nsubjpass"), "nsubjpass"
OBJECTS = ("dobj", "attr", "dative", "oprd")
#: The first position of a sentence in its document is its number times this.
STRIDE = 1 << 32


# Forms of "be" before a participle, and the word before the one who acts.
BE, AGENT = ("is", "are", "was", "were", "been", "being", "be"), "by"


#: Kinds of words: others, names, prepositions, "and", lower-case words.
OTHER, NAME, PREP, AND, LOW = range(5)
DEPS, TAGS = ("root", "nsubj", "conj", "pobj", "dobj", "prep", PASSIVE), ("X", "VERB", "PROPN", "ADP")


def _heads(size: np.ndarray, kind: np.ndarray, passive: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(sentence, position in it, dep, tag, position of the head) of the words of sentences of these sizes.

    kind of each word; passive, if wanted, has the bits 1, 2 and 4 for forms of "be", participles and AGENT.
    """
    n = len(kind)
    own = np.repeat(np.arange(len(size)), size)
    start, j = np.repeat(size.cumsum() - size, size), np.arange(n)
    end = start + size[own]
    moved = lambda a, k, none: np.where((j + k >= start) & (j + k < end), a[np.clip(j + k, 0, max(0, n - 1))], none)

    def last(c: np.ndarray) -> np.ndarray:
        """The last word before, in the sentence, for which c holds; -1 without one."""
        at = np.concatenate([[-1], np.maximum.accumulate(np.where(c, j, -1))[:-1]])[:n]
        return np.where(at >= start, at, -1)

    name, prev, after = kind == NAME, moved(kind, -1, -1), moved(kind, 1, -1)
    verb = (kind == LOW) & (prev == NAME)
    v, e, p = last(verb), last(name), last(kind == PREP)
    under = (v >= 0) & (e >= 0) & (e < v)
    rules = [name & (after == LOW), name & (prev == AND) & (e == j - 2), name & under & (p > v), name & under, (kind == PREP) & under]
    dep, head = np.select(rules, range(1, 6), 0), np.select(rules, [j + 1, e, p, v, v], j)
    tag = np.select([verb, name, kind == PREP], [1, 2, 3], 0)
    if passive is not None:
        run = name & ((moved(passive, 1, 0) & 1) > 0) & ((moved(passive, 2, 0) & 2) > 0) & ((moved(passive, 3, 0) & 4) > 0) & moved(name, 4, False)
        part = [run, moved(run, -2, False), moved(run, -3, False), moved(run, -4, False)]
        dep, head = np.select(part, [6, 0, 5, 3], dep), np.select(part, [j + 2, j, j - 1, j - 1], head)
        tag = np.select([part[0], part[1], part[2]], [tag, 1, 3], tag)
    return own, j - start, dep, tag, head - start


def _sentences(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, sent, text, kind: a row per sentence with its words and their kinds."""

    def kind(w):
        low = F.lower(w)
        name = F.regexp_like(w, F.lit(r"^\p{Lu}\p{L}+$")) & ~low.isin(ENTITY_STOP + SENTENCE_STARTS)
        return F.when(name, NAME).when(low.isin(list(PREPOSITIONS)), PREP).when(low == "and", AND).when(F.regexp_like(w, F.lit(r"^\p{Ll}+$")), LOW).otherwise(OTHER)

    sentences = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END)).alias("sent", "s"))
    words = sentences.select("doc_id", "sent", F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("text")).filter(F.size("text") > 0)
    return words.withColumn("kind", F.transform("text", kind))


def spanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, i, name: the tokens of parsed() from a sentence's first name to its last, with the first name.

    A span ends in its sentence, so tokens and spans meet in the sentence's row and only the ids are shuffled, to find those
    that several rows share: sentences of one number are one span there, by span_tokens(). Rows without an id have no tokens.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.filter("doc_id is not null").select("doc_id", F.col(text).alias("text"))
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "repeated")
    several = bool(repeated.limit(1).count())

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("text").offsets.to_numpy()).astype(np.int64)
            own, j = np.repeat(np.arange(len(size)), size), np.arange(size.sum())
            name = np.flatnonzero(b.column("kind").flatten().to_numpy() == NAME)
            first, last = np.full(len(size), len(j)), np.full(len(size), -1)
            np.minimum.at(first, own[name], name)
            np.maximum.at(last, own[name], name)
            keep = np.flatnonzero((j >= first[own]) & (j <= last[own]))
            sent, at = own[keep], keep - (size.cumsum() - size)[own[keep]]
            i = b.column("sent").to_numpy().astype(np.int64)[sent] * STRIDE + at
            words = b.column("text").flatten()
            yield pa.record_batch([b.column("doc_id").take(pa.array(sent)), pa.array(i), words.take(pa.array(first[sent]))], ["doc_id", "i", "name"])

    single = docs.join(repeated, "doc_id", "left_anti") if several else docs
    words = _sentences(single, "text").filter(F.array_contains("kind", NAME))
    kind = words.schema["doc_id"].dataType.simpleString()
    out = words.mapInArrow(covered, f"doc_id {kind}, i long, name string").withColumn("name", F.lower("name"))
    if not several:
        return out
    tokens = cut(parsed(docs.join(repeated, "doc_id", "left_semi")).select("doc_id", "sent", "i", "name"), "tokens")
    spans = tokens.filter("name is not null").groupBy("doc_id", F.col("sent").alias("seq")).agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.min_by("name", "i").alias("name"))
    return out.unionByName(span_tokens(tokens.select("doc_id", "i"), spans).filter("name is not null").select("doc_id", "i", "name"))


def parsed(docs: DataFrame, text: str = "text", passives: bool = False, others: bool = True) -> DataFrame:
    """The token table of docs(doc_id, text) by rules of the order of words; names are capitalised words.

    The word after a name is a verb and the name its subject. The next name after a verb is its object, or the object
    of the last preposition between them, which hangs from the verb. A name after "and" is a conjunct of the name
    before. Everything else is a root. A null text has no tokens. passives: as with_passives() gives it. Without
    others, words that are neither names, verbs nor prepositions are left out: no relation has them.

    A sentence is one row until its words have their heads, so nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    words = _sentences(docs, text)

    def marks(w):
        low = F.lower(w)
        return F.when(low.isin(*BE), 1).otherwise(0) + F.when(F.regexp_like(low, F.lit("^.+(?:ed|en|n|t)$")), 2).otherwise(0) + F.when(low == AGENT, 4).otherwise(0)

    if passives:
        words = words.withColumn("marks", F.transform("text", marks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("text").offsets.to_numpy()).astype(np.int64)
            kinds = b.column("kind").flatten().to_numpy()
            own, at, dep, tag, head = _heads(size, kinds, b.column("marks").flatten().to_numpy() if passives else None)
            keep = np.arange(len(at)) if others else np.flatnonzero(tag > 0)
            first = b.column("sent").to_numpy().astype(np.int64)[own[keep]] * STRIDE
            taken = lambda names, code: pa.array(names).take(pa.array(code[keep]))
            columns = [b.column(c).take(pa.array(own[keep])) for c in ("doc_id", "sent")] + [pa.array(first + at[keep]), b.column("text").flatten().take(pa.array(keep)), taken(TAGS, tag), taken(DEPS, dep), pa.array(first + head[keep]), pa.array(kinds[keep] == NAME)]
            yield pa.record_batch(columns, ["doc_id", "sent", "i", "text", "pos", "dep", "head", "named"])

    t = words.mapInArrow(rows, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, sent int, i long, text string, pos string, dep string, head long, named boolean")
    low = F.lower("text")
    return t.select("doc_id", "sent", "i", "text", low.alias("lemma"), "pos", "dep", "head", F.when(F.col("named"), low).alias("name"))


def with_passives(tokens: DataFrame) -> DataFrame:
    """The token table of parsed() with passives: name, a form of "be", a participle (-ed, -en, -n, -t), "by", name.

    The first name becomes the participle's passive subject, "by" its preposition and the second name that one's object.
    """
    order = Window.partitionBy("doc_id", "sent").orderBy("i")
    at = lambda c, k: F.lead(c, k).over(order) if k > 0 else F.lag(c, -k).over(order)
    word = lambda k: F.lower(at("text", k)) if k else F.lower(F.col("text"))
    name = lambda k: (at("pos", k) if k else F.col("pos")) == "PROPN"

    def found(k: int):
        """Whether such a run starts k tokens before this one."""
        return F.coalesce(name(-k) & word(1 - k).isin(*BE) & F.regexp_like(word(2 - k), F.lit("^.+(?:ed|en|n|t)$")) & (word(3 - k) == AGENT) & name(4 - k), F.lit(False))

    part = F.when(found(0), 0).when(found(2), 2).when(found(3), 3).when(found(4), 4)
    out = tokens.withColumns({"__part": part, "__back": at("i", -1), "__on": at("i", 2)})
    dep = F.when(F.col("__part") == 0, PASSIVE).when(F.col("__part") == 3, "prep").when(F.col("__part") == 4, "pobj").when(F.col("__part") == 2, "root").otherwise(F.col("dep"))
    head = F.when(F.col("__part") == 0, F.col("__on")).when(F.col("__part").isin(3, 4), F.col("__back")).when(F.col("__part") == 2, F.col("i")).otherwise(F.col("head"))
    pos = F.when(F.col("__part") == 2, "VERB").when(F.col("__part") == 3, "ADP").otherwise(F.col("pos"))
    return out.select("doc_id", "sent", "i", "text", "lemma", pos.alias("pos"), dep.alias("dep"), head.alias("head"), "name")


def named(tokens: DataFrame, spans: DataFrame, referents: DataFrame | None = None, last_wins: bool = True) -> DataFrame:
    """tokens with name: the entity whose span covers the token, else what its pronoun stands for.

    spans(doc_id, seq, name, start, end); referents(doc_id, last_person, last_other) as graph.referents() gives them.
    """
    out = span_tokens(tokens.drop("name"), spans, last_wins)
    if referents is None:
        return out
    word = F.lower("text")
    stands = F.when(word.isin(*PERSON_PRONOUNS), F.col("last_person")).when(word.isin(*OTHER_PRONOUNS), F.col("last_other"))
    return out.join(referents, "doc_id", "left").withColumn("name", F.coalesce("name", stands)).drop("last_person", "last_other")


def _reached(steps: DataFrame) -> DataFrame:
    """(doc_id, i, j, depth): what is reached from i by steps(doc_id, i, j), by doubling; shortest depth."""
    found = cut(steps.select("doc_id", "i", "j", F.lit(1).alias("depth")), "steps")
    while True:
        more = found.select("doc_id", F.col("i").alias("j"), F.col("j").alias("k"), F.col("depth").alias("d"))
        longer = found.join(more, ["doc_id", "j"]).select("doc_id", "i", F.col("k").alias("j"), (F.col("depth") + F.col("d")).alias("depth"))
        grown = cut(found.unionByName(longer).groupBy("doc_id", "i", "j").agg(F.min("depth").alias("depth")), "steps")
        if grown.count() == found.count():
            return grown
        found = grown


def conjuncts(tokens: DataFrame, transitive: bool = True) -> DataFrame:
    """(doc_id, i, j): the token itself and its conjuncts; transitive follows conjuncts of conjuncts."""
    return tokens.select("doc_id", "i", F.col("i").alias("j")).unionByName(_further(tokens, transitive))


def _further(tokens: DataFrame, transitive: bool) -> DataFrame:
    """conjuncts() without the tokens themselves."""
    steps = tokens.filter((F.col("dep") == "conj") & (F.col("head") != F.col("i"))).select("doc_id", F.col("head").alias("i"), F.col("i").alias("j"))
    return _reached(steps).select("doc_id", "i", "j") if transitive else steps


def _clauses(tokens: DataFrame, transitive: bool) -> tuple[DataFrame, DataFrame]:
    """(subjects (doc_id, v, lemma, subj, passive), objects (doc_id, v, obj, prep)) of verbs, conjuncts expanded."""
    verbs = tokens.filter("pos = 'VERB'").select("doc_id", F.col("i").alias("v"), "lemma")
    names = tokens.filter("name is not null").select("doc_id", F.col("i").alias("j"), "name")
    held = names.withColumnRenamed("j", "c").unionByName(_further(tokens, transitive).join(names, ["doc_id", "j"]).select("doc_id", F.col("i").alias("c"), "name"))
    child = tokens.filter("head != i").select("doc_id", F.col("head").alias("v"), F.col("i").alias("c"), "dep", F.lower("lemma").alias("word"))
    subjects = verbs.join(child.filter(F.col("dep").isin(*SUBJECTS)), ["doc_id", "v"]).join(held, ["doc_id", "c"])
    subjects = subjects.select("doc_id", "v", "lemma", F.col("name").alias("subj"), (F.col("dep") == PASSIVE).alias("passive"))
    direct = child.filter(F.col("dep").isin(*OBJECTS)).join(held, ["doc_id", "c"]).select("doc_id", "v", F.col("name").alias("obj"), F.lit(None).cast("string").alias("prep"))
    preps = child.filter("dep = 'prep'").select("doc_id", "v", F.col("c").alias("p"), F.col("word").alias("prep"))
    under = child.filter("dep = 'pobj'").select("doc_id", F.col("v").alias("p"), "c").join(held, ["doc_id", "c"])
    by_prep = preps.join(under, ["doc_id", "p"]).select("doc_id", "v", F.col("name").alias("obj"), "prep")
    return subjects, direct.unionByName(by_prep)


def clause_relations(tokens: DataFrame) -> DataFrame:
    """doc_id, src, relation, dst, distinct: subject, verb, object; objects of prepositions by the preposition's relation.

    A preposition without a relation of its own makes verb_preposition; stop verbs make none; conjuncts of conjuncts count.
    """
    subjects, objects = _clauses(tokens, True)
    verb = F.lower("lemma")
    by_prep = F.coalesce(_looked_up(PREPOSITIONS, F.col("prep")), F.concat(verb, F.lit("_"), F.col("prep")))
    found = subjects.filter(~verb.isin(VERB_STOP)).join(objects, ["doc_id", "v"]).filter("subj != obj")
    return found.select("doc_id", F.col("subj").alias("src"), F.when(F.col("prep").isNull(), verb).otherwise(by_prep).alias("relation"), F.col("obj").alias("dst")).distinct()


def verb_relations(tokens: DataFrame, stop_first: bool = True) -> DataFrame:
    """doc_id, src, relation, dst, distinct: all objects under the verb's relation; a passive subject is the object.

    Direct conjuncts only. A verb with any passive subject is passive. stop_first as in graph.relation_of().
    """
    subjects, objects = _clauses(tokens, False)
    passive = subjects.groupBy("doc_id", "v").agg(F.max("passive").alias("swap"))
    found = subjects.drop("passive").join(passive, ["doc_id", "v"]).withColumn("relation", relation_of(F.col("lemma"), stop_first))
    found = found.filter(F.coalesce("relation", F.lit("")) != "").join(objects, ["doc_id", "v"]).filter("subj != obj")
    src, dst = F.when(F.col("swap"), F.col("obj")).otherwise(F.col("subj")), F.when(F.col("swap"), F.col("subj")).otherwise(F.col("obj"))
    return found.select("doc_id", src.alias("src"), "relation", dst.alias("dst")).distinct()


def ancestors(tokens: DataFrame) -> DataFrame:
    """(doc_id, i, a, depth): every token's way up to its root, itself at depth 0."""
    steps = tokens.filter("head != i").select("doc_id", "i", F.col("head").alias("j"))
    own = tokens.select("doc_id", "i", F.col("i").alias("a"), F.lit(0).alias("depth"))
    return own.unionByName(_reached(steps).select("doc_id", "i", F.col("j").alias("a"), "depth"))


def path_relations(tokens: DataFrame) -> DataFrame:
    """doc_id, src, relation, dst, distinct: names whose ways to the root share a verb, the one nearest to the first.

    Names meet under their common verbs, not as pairs of a sentence, so that unrelated names never meet.
    """
    verbs = tokens.filter("pos = 'VERB'").select("doc_id", F.col("i").alias("a"), F.lower("lemma").alias("verb"))
    ways = ancestors(tokens).join(tokens.filter("name is not null").select("doc_id", "i", "name"), ["doc_id", "i"]).join(verbs, ["doc_id", "a"])
    other = ways.select("doc_id", "a", F.col("i").alias("i2"), F.col("name").alias("dst"))
    met = ways.join(other, ["doc_id", "a"]).filter("i != i2 and name != dst")
    one = met.groupBy("doc_id", "i", "i2", F.col("name").alias("src"), "dst").agg(F.min_by("verb", F.struct("depth", "a")).alias("relation"))
    return one.select("doc_id", "src", "relation", "dst").distinct()
