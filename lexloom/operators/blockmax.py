"""BM25 by blocks of postings with their maxima: upper bounds of groups of documents first, scores where they may matter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import cut

from .index import Index
from .search import DIGITS, K1, TOP_K, B, _gain, query_terms, top_k

#: Documents of a range, expected: a block holds the postings of a token in a range.
RANGE_DOCS = 64
#: Ranges per wanted document that are scored first, to find a threshold.
FIRST = 4


def range_of(doc_id: Column, ranges: int) -> Column:
    """The range of a document, by its MD5."""
    number = F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(F.coalesce(number, F.lit(0)), F.lit(ranges))


@dataclass(frozen=True)
class BlockIndex:
    """blocks(token, range, n, top, postings array<struct<doc_id, gain>>), the highest gain first; top is that gain.

    A gain is a posting's part in the score, without the token's idf, for one k1 and b.
    """

    blocks: DataFrame
    idf: DataFrame
    stem: bool = False

    @classmethod
    def build(cls, index: Index, k1: float = K1, b: float = B, range_docs: int = RANGE_DOCS) -> BlockIndex:
        """Of an index's postings, by one shuffle on (token, range)."""
        ranges = max(1, -(-index.n // range_docs))
        gain = _gain(F.col("f"), F.col("len"), index.avgdl or 1.0, k1, b)
        rows = index.tf.select("token", range_of(F.col("doc_id"), ranges).alias("range"), "doc_id", gain.alias("gain"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("less"), "doc_id")))
        postings = F.transform(listed, lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["less"]).alias("gain")))
        blocks = rows.groupBy("token", "range").agg(F.count("*").alias("n"), F.max("gain").alias("top"), postings.alias("postings"))
        return cls(cut(blocks, "blocks"), index.idf, index.stem)

    def save(self, path: str) -> None:
        """Parquet tables below path, sorted by token and range, so that a lookup skips row groups."""
        self.blocks.repartitionByRange("token", "range").sortWithinPartitions("token", "range").write.mode("overwrite").parquet(f"{path}/blocks")
        self.idf.write.mode("overwrite").parquet(f"{path}/block_idf")
        self.blocks.sparkSession.createDataFrame([(self.stem,)], "stem boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/block_settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/block_idf"), spark.read.parquet(f"{path}/block_settings").first()[0])

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, token, w): the idf times the multiplicity of the tokens of queries(query_id, tokens)."""
        return query_terms(queries, self.stem).join(self.idf.select("token", "idf"), "token").select("query_id", "token", (F.col("m") * F.col("idf")).alias("w"))

    def bounds(self, weights: DataFrame) -> DataFrame:
        """(query_id, range, bound, blocks): no document of the range scores more, of the query's blocks there.

        Reads the maxima alone. A token of negative weight adds nothing to a bound.
        """
        met = weights.join(self.blocks.select("token", "range", "top"), "token")
        return met.groupBy("query_id", "range").agg(F.sum(F.greatest(F.col("w") * F.col("top"), F.lit(0.0))).alias("bound"), F.count("*").alias("blocks"))

    def scores(self, weights: DataFrame, ranges: DataFrame) -> DataFrame:
        """query_id, doc_id, score of all documents of ranges(query_id, range) that hold a token of the query."""
        wanted = ranges.select("query_id", "range").join(weights, "query_id")
        met = wanted.join(self.blocks.select("token", "range", "postings"), ["token", "range"])
        each = met.select("query_id", "w", F.explode("postings").alias("p"))
        return each.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.round(F.sum(F.col("w") * F.col("p.gain")), DIGITS).alias("score"))

    def search(self, queries: DataFrame, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
        """(results, work): the k best of queries(query_id, tokens) as search.bm25() gives them, and what it took.

        results: query_id, doc_id, score, rank. work: query_id, ranges, scored_ranges, blocks, scored_blocks.

        1. The bounds of all ranges, from the blocks' maxima.
        2. The FIRST * k ranges of the highest bounds are scored; a query's k-th score there is its threshold.
        3. Of the other ranges those are scored whose bound reaches it. A document that scores as much as the threshold
           lies in a range that is scored, so the k best are exact, ties included.
        """
        weights = cut(self.weights(queries), "weights")
        bounds = cut(self.bounds(weights), "bounds")
        first = cut(top_k(bounds.select("query_id", F.col("range").alias("doc_id"), F.col("bound").alias("score")), FIRST * k).select("query_id", F.col("doc_id").alias("range")), "first")
        found = cut(self.scores(weights, first), "scored")
        least = top_k(found, k).groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).filter(F.col("c") >= k).select("query_id", "least")
        # sums and the rounded score differ by their last digits
        open_ranges = bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS))
        rest = cut(open_ranges.join(first, ["query_id", "range"], "left_anti").select("query_id", "range"), "rest")
        results = top_k(found.unionByName(self.scores(weights, rest)), k)
        read = first.unionByName(rest).withColumn("read", F.lit(1))
        work = bounds.join(read, ["query_id", "range"], "left").groupBy("query_id").agg(
            F.count("*").alias("ranges"), F.count("read").alias("scored_ranges"), F.sum("blocks").alias("blocks"), F.coalesce(F.sum(F.when(F.col("read") == 1, F.col("blocks"))), F.lit(0)).alias("scored_blocks")
        )
        return results, work
