"""Upkeep of an index's statistics under changes: keyed state per document, deltas per token."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexloom.sources.files import exists
from lexloom.storage import fresh_path, table

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "doc_id long, version long, text string, deleted boolean"
#: token is null in the rows that change the number of documents and the sum of their lengths.
DELTAS = "token string, docs long, occurrences long"


def tokens_of(text: str | None) -> list[str]:
    """functions.text.tokens() of one text in a worker."""
    return [w for w in re.findall(r"\w+", (text or "").lower()) if w != "_"]


class Upkeep(StatefulProcessor):
    """State of a document: its version, whether it is deleted, and the tokens that it counts for.

    A deleted document's version is remembered, so that older changes of it come to nothing: for keep_deleted
    milliseconds, by a timer, or for good.
    """

    def __init__(self, keep_deleted: int | None = None):
        self.keep_deleted = keep_deleted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "version long, deleted boolean, counts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The deltas from what the document counted for to its newest version; older versions are passed over."""
        old = self.held.get() if self.held.exists() else None
        version = old[0] if old else None
        newest, gone, changed = None, False, False
        for b in rows:
            for v, text, deleted in zip(b["version"], b["text"], b["deleted"]):
                # a version that comes twice counts once; of two texts under one version the first that was read stays
                if version is None or v > version:
                    version, newest, gone, changed = int(v), text if isinstance(text, str) else "", bool(deleted), True
        if not changed:
            return
        before = Counter(json.loads(old[2])) if old and not old[1] else Counter()
        after = Counter() if gone else Counter(tokens_of(newest))
        self.held.update((version, gone, "{}" if gone else json.dumps(after)))
        if gone and self.keep_deleted is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_deleted)
        delta = [(t, (t in after) - (t in before), after[t] - before[t]) for t in before.keys() | after.keys()]
        delta = [d for d in delta if d[1] or d[2]]
        was, now = int(bool(old and not old[1])), int(not gone)
        if was != now or after.total() != before.total():
            delta.append((None, now - was, after.total() - before.total()))
        if delta:
            yield pd.DataFrame(delta, columns=["token", "docs", "occurrences"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forgets a document that is still deleted."""
        if self.held.exists() and self.held.get()[1]:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def maintain(changes: DataFrame, path: str, keep_deleted: int | None = None, interval: str = "10 seconds"):
    """A query that turns a stream of changes(doc_id, version, text, deleted) into deltas below path/deltas.

    A change replaces or deletes a document; of a document's changes the highest version counts, in whatever order and
    batch they come. A batch that is repeated after a failure overwrites its own folder.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    found = changes.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Upkeep(keep_deleted), outputStructType=DELTAS, outputMode="Update", timeMode="None" if keep_deleted is None else "ProcessingTime")

    def save(batch: DataFrame, batch_id: int) -> None:
        # a batch's deltas of a token are summed before they are written
        summed = batch.groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))
        summed.write.mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}")

    writer = found.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{path}/state")
    return (writer.trigger(availableNow=True) if keep_deleted is None else writer.trigger(processingTime=interval)).start()


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """token, n_t, tf as they stand; the row of the null token has the number of documents and the sum of their lengths."""
    if not exists(spark, f"{path}/deltas"):
        return spark.createDataFrame([], "token string, n_t long, tf long")
    rows = spark.read.schema(DELTAS + ", batch long").parquet(f"{path}/deltas")
    summed = rows.groupBy("token").agg(F.sum("docs").alias("n_t"), F.sum("occurrences").alias("tf"))
    return summed.filter("n_t != 0 or tf != 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, n_t, tf after three batches of changes that are made from the documents table.

    First every document comes in; then those whose id is divisible by 3 are replaced (their source's name follows the
    text) and those with remainder 3 by 7 are deleted; last an older version of every document comes late.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = fresh_path(spark, "upkeep")
    first = docs.select("doc_id", F.lit(2).cast("long").alias("version"), "text", F.lit(False).alias("deleted"))
    replaced = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(3).cast("long").alias("version"), F.concat_ws(" ", "text", "source").alias("text"), F.lit(False).alias("deleted"))
    gone = docs.filter("doc_id % 7 = 3").select("doc_id", F.lit(4).cast("long").alias("version"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))
    late = docs.select("doc_id", F.lit(1).cast("long").alias("version"), F.col("source").alias("text"), F.lit(False).alias("deleted"))
    for batch in (first, replaced.unionByName(gone), late):
        batch.write.mode("append").parquet(f"{path}/changes")
        maintain(spark.readStream.schema(CHANGES).parquet(f"{path}/changes"), path).awaitTermination()
    return statistics(spark, path)
