"""Connected components, and names that are aliases of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.storage import cut


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of links(a, b) the smallest node that it is connected with.

    Union by hooking and pointer jumping, as joins: the root of each link's ends hooks onto the smallest root that it
    meets, then every node jumps to its root's root until nothing moves. A round at least halves the roots of a
    component that can hook, so rounds grow with the logarithm of its size; each is written to the shared folder. A
    node of very many links is reduced by partial minima before any shuffle.
    """
    both = links.select("a", "b").filter("a is not null and b is not null")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    # self-links keep nodes that have no other
    parent = cut(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "parents")
    while True:
        ends = both.join(parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(parent.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = cut(ends.filter("rb < ra").groupBy(F.col("ra").alias("root")).agg(F.min("rb").alias("to")), "hooks")
        if not hooks.limit(1).count():
            return parent
        # what a root hooks onto may hook itself: jump until each target is a root that stays
        while True:
            further = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = cut(hooks.join(further, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("root", "to")
            if not jumped.filter("moved").limit(1).count():
                break
        parent = cut(parent.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "parents")


def alias_evidence(ents: DataFrame) -> DataFrame:
    """short, long, docs: names whose words are some of another name's, and the documents that have both.

    ents(doc_id, name). The names of a document meet under their words; a short name of n words is part of a longer one
    with which it shares n.
    """
    one = ents.select("doc_id", "name").distinct().withColumn("words", F.array_distinct(F.split("name", " ")))
    each = one.select("doc_id", "name", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = each.select("doc_id", F.col("name").alias("long"), F.col("n").alias("m"), "word")
    met = each.join(other, ["doc_id", "word"]).filter("n < m").groupBy("doc_id", "name", "long", "n").agg(F.count("*").alias("shared"))
    return met.filter("shared = n").groupBy(F.col("name").alias("short"), "long").agg(F.count("*").alias("docs"))


def alias_classes(ents: DataFrame, least: int = 1) -> DataFrame:
    """name, class: names that stand for the same, by the smallest name of their class.

    A short name goes with the longer one that most documents have beside it, ties to the smaller; less than `least`
    documents are no evidence. Classes are the components of these links, so that short forms of short forms join.
    """
    best = alias_evidence(ents).filter(F.col("docs") >= least).groupBy("short").agg(F.min_by("long", F.struct(-F.col("docs"), "long")).alias("long"))
    return components(best.select(F.col("short").alias("a"), F.col("long").alias("b"))).select(F.col("node").alias("name"), F.col("root").alias("class"))
