"""Sessions: sensible defaults, and the package shipped to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A single-node session for tests and benchmarks; on a cluster the submitter's settings hold."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("lexloom")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as a zip through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexloom-ship-"), "lexloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lexloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
