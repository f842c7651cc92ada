"""Retrieval metrics, macro means, parameter sweeps and method comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("p_at_k", "r_at_k", "ap", "mrr", "ndcg")


def metrics(retrieved: DataFrame, gold: DataFrame, keys: DataFrame, k: int = 5, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """group, query_id, overlap, p_at_k, r_at_k, ap, mrr, ndcg.

    retrieved(group, query_id, doc_id, rank); gold(query_id, doc_id, pos), pos from 1 and possibly with repeated
    documents; keys(group, query_id) names the rows wanted, results or not. Precision divides by the number
    retrieved, average precision by all relevant ones; a document's grade is (length of its list) - (its last
    position) + 1, and gains are exponential, scaled by the best grade so that long lists do not overflow. Empty
    results or gold give 0.
    """
    sizes = gold.groupBy("query_id").agg(F.countDistinct("doc_id").alias("relevant"), F.max("pos").alias("length"))
    last = gold.groupBy("query_id", "doc_id").agg(F.max("pos").alias("last")).join(sizes, "query_id")
    graded = last.withColumn("grade", F.col("length") - F.col("last") + 1)
    gain = (F.pow(F.lit(2.0), F.col("grade") - F.col("length")) - F.pow(F.lit(2.0), -F.col("length")))
    graded = graded.withColumn("gain", gain)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = graded.withColumn("i", place).filter(F.col("i") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1.0)).alias("idcg"))
    ret = retrieved.filter(F.col("rank") <= k).join(graded.select("query_id", "doc_id", "gain"), ["query_id", "doc_id"], "left")
    hit = F.when(F.col("gain").isNotNull(), 1).otherwise(0)
    ret = ret.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(Window.partitionBy(*group, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    per = ret.groupBy(*group, "query_id").agg(
        F.count("*").alias("n"), F.sum("hit").alias("overlap"), F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("precisions"),
        F.max(F.col("hit") / F.col("rank")).alias("mrr"), F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    out = keys.join(per, [*group, "query_id"], "left").join(sizes, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(
        *group, "query_id", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), zero(F.try_divide("overlap", "n")).alias("p_at_k"),
        zero(F.try_divide("overlap", "relevant")).alias("r_at_k"), zero(F.try_divide("precisions", "relevant")).alias("ap"),
        zero(F.col("mrr")).alias("mrr"), zero(F.try_divide("dcg", "idcg")).alias("ndcg"),
    )


def macro_means(per_query: DataFrame, *group: str) -> DataFrame:
    return per_query.groupBy(*(group or ("method",))).agg(*(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def ranking(means: DataFrame) -> DataFrame:
    """means with rank by nDCG, ties by name; one row per method."""
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ndcg"), "method")).cast("long"))


def overall(means: DataFrame) -> DataFrame:
    """method, overall: each metric scaled to [0, 1] over the methods, then the mean; constant metrics are passed over."""
    w = Window.partitionBy()
    scaled = [F.try_divide(F.col(m) - F.min(m).over(w), F.max(m).over(w) - F.min(m).over(w)) for m in METRICS]
    wide = means.select("method", *(s.alias(m) for s, m in zip(scaled, METRICS)))
    known = F.array_compact(F.array(*METRICS))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return wide.select("method", F.round(mean, 6).alias("overall"))


def stats(per_query: DataFrame, metric: str = "ndcg") -> DataFrame:
    """method, n, mean, low, high, std (sample; null for one row)."""
    return per_query.groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"), F.min(metric).alias("low"), F.max(metric).alias("high"),
        F.round(F.stddev_samp(metric), 6).alias("std"),
    )


def base_name(method):
    """A method's name without its last word."""
    return F.regexp_replace(method, " [^ ]*$", "")
