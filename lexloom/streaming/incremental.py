"""Structured Streaming: windowed event counts with late data, and an index that grows by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import tokens
from lexloom.sources.files import exists
from lexloom.storage import fresh_path


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """start, event_type, n, total per tumbling window; state older than the watermark is dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Everything a stream has now, through an exactly-once file sink; what the watermark holds back stays back."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def latest(stream: DataFrame, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The last state of every key of an aggregation, those that are still open included.

    Update mode gives a key out whenever it changes; a batch writes (or overwrites) its own folder, and the newest
    row of a key counts. The watermark still drops state that cannot change any more.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    if not exists(stream.sparkSession, f"{path}/out"):
        return stream.sparkSession.createDataFrame([], stream.schema)
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return newest.select("row.*")


def index_stream(docs: DataFrame, path: str):
    """Write postings (token, doc_id, f, len) of a stream of documents(doc_id, text), a folder per batch.

    A repeated batch overwrites its own folder, so that a restart neither loses nor doubles postings; statistics are
    aggregates over the folders (see statistics()).
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        toks = batch.select("doc_id", tokens(F.col("text")).alias("t"))
        rows = toks.select("doc_id", F.size("t").cast("long").alias("len"), F.explode_outer("t").alias("token"))
        rows.groupBy("token", "doc_id", "len").agg(F.count("token").alias("f")).write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """token, n_t, tf over all batches."""
    found = spark.read.parquet(f"{path}/postings").filter("token is not null")
    return found.groupBy("token").agg(F.count("*").alias("n_t"), F.sum("f").alias("tf"))


def events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts per event type, by a stream over the events table read in a single pass.

    Windows that the watermark has not passed yet are part of the result, as they stand.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream = raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return latest(windowed(stream), fresh_path(spark, "stream"), ("start", "event_type"))


def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    path = fresh_path(spark, "index-stream")
    index_stream(docs, path).awaitTermination()
    return statistics(spark, path)
