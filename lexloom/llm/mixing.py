"""Mixing sources to target weights: repetition rates per source, then whole copies plus one hash-seeded coin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_RATE = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document's id only."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the water-filling of the budget.

    Sources by code point, null last, get the weights in turn. The budget is shared by weight; a share stops at
    max_rate times its source's size and the excess goes to the others by weight. Closed form of that repeated
    resharing: sources fill in the order of capacity per weight, so with the k fullest taken out the level is
    (budget - their capacity) / (weight of the rest); k is the number of sources whose capacity lies at or below
    the level that holds without those before them. One row per source takes part, after the aggregation.
    """
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = sizes.withColumn("w", weight).withColumn("cap", (max_rate * F.col("source_size")).cast("double"))
    out = out.withColumn("ratio", F.col("cap") / F.col("w"))
    out = out.withColumn("budget", F.sum("source_size").over(everything).cast("double") * budget_percent / 100)
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    out = out.withColumn("full", F.col("ratio") <= F.col("level"))
    # the first source in order that is not full fixes the common level; the levels after it only fall
    out = out.withColumn("common", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("w") * F.col("common"), F.col("cap")))
    return out.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    copies is floor(rate) plus one if the document's coin lies below the fraction of rate = target / source_size;
    taken is copies * size. Nothing but (source, size) sums is shuffled for the rates; a source that holds most
    rows is summed before its shuffle, and the small table of rates meets the documents in a join that Spark
    broadcasts when its measured size allows and otherwise splits by skew. Null text: size 0. Null source: a
    source of its own, last in order. Empty table: empty result. If all sizes are 0, targets, rates and copies are
    0. Repeated rows with one id get the same copies; a null id tosses the coin of 'null'. Columns of docs with
    the added names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.select(*keep, size_of(F.col(text)).alias("size"))
    sizes = docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sizes).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (coin(F.col(doc_id), seed) < rate - whole).cast("long")
    return (
        sized.join(rates, sized[source].eqNullSafe(rates["__source"]), "inner").drop("__source")
        .withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as its copies say."""
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(copies)).drop("__copy")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle_rows(table: str, seed: str = SEED) -> str:
    """CTEs mixed(doc_id, size, source_size, target, copies) over the columns doc_id, text, source of table."""
    return f"""
    sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}),
    per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    wt AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
             WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             ({MAX_RATE} * source_size)::DOUBLE AS cap, (SELECT sum(source_size) FROM per)::DOUBLE * {BUDGET_PERCENT} / 100 AS budget FROM per),
    lv AS (SELECT *, cap / w AS ratio,
             (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
    tg AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE
             least(w * (SELECT max(level) FROM lv WHERE ratio > level), cap) END AS target FROM lv),
    rt AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM tg),
    mixed AS (SELECT s.doc_id, s.size, r.source_size, r.target,
        (floor(r.rate) + CASE WHEN ('0x' || substr(md5('{seed}:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE
           < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM sized s JOIN rt r ON s.source IS NOT DISTINCT FROM r.source)"""


def oracle() -> str:
    return f"WITH {oracle_rows('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
