"""Where intermediate tables go: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    spark.checkpoint.dir wins, then a checkpoint directory set on the context. Only a local[...] master,
    where driver and executors are one process, may fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="lexloom-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        found = "file://" + _LOCAL[app]
    return found.rstrip("/")


_OWN: set[str] = set()
#: The folders of cut()'s tables.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def own_dir(spark: SparkSession) -> str:
    """The application's folder below shared_dir(). Spark's file system deletes it when the application ends."""
    folder = f"{shared_dir(spark)}/lexloom-{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below own_dir() that nothing else uses."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: ends the lineage and survives lost executors. Its shuffle files go."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def same_table(df: DataFrame, written: DataFrame) -> DataFrame:
    """df, which reads cut()'s table `written`: discard(df) deletes that table."""
    _WRITTEN[df] = _WRITTEN[written]
    return df


def discard(df: DataFrame) -> None:
    """Delete the table that cut() gave as df; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries made within give their shuffle files back when they end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes in an Arrow batch between the JVM and Python workers. Spark's default of 64 MB is held several times over on
#: both sides of each running task.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to BATCH_BYTES, where it is higher; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
