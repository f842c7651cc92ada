"""A saved index as a Spark data source: only the files and row groups that may hold the tokens asked for are opened."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "lexloom_postings"
SCHEMA = "token string, doc_id long, f long, len long"


def write_manifest(spark: SparkSession, path: str) -> None:
    """path/files: the name of each file of path/postings with its least and greatest token, in one file."""
    rows = spark.read.parquet(f"{path}/postings").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    rows.agg(F.min("token").alias("least"), F.max("token").alias("most")).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def save(tf: DataFrame, path: str, n: int, avgdl: float, avg_idf: float, stem: bool = False) -> None:
    """Postings tf(token, doc_id, f, len) for this source: ranges of tokens by file, sorted, with a manifest and the corpus's numbers."""
    spark = tf.sparkSession
    ordered = tf.select("token", F.col("doc_id").cast("long").alias("doc_id"), "f", "len").repartitionByRange("token").sortWithinPartitions("token", "doc_id")
    ordered.write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    write_manifest(spark, path)
    spark.createDataFrame([(n, avgdl, avg_idf, stem)], "n long, avgdl double, avg_idf double, stem boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def small_table(path: str) -> list[dict]:
    """A table of one small file."""
    fs, at = _place(path)
    return pq.read_table(at, filesystem=fs).to_pylist()


@lru_cache(maxsize=64)
def manifest(path: str) -> tuple[tuple[str, str, str], ...]:
    """(file, least, most) by least token; kept per process, as a saved index does not change."""
    return tuple(sorted((r["file"], r["least"], r["most"]) for r in small_table(f"{path}/files") if r["least"] is not None))


def files_of(path: str, tokens: frozenset | None) -> list[str]:
    """The files whose range of tokens holds one of those asked for, or all of them."""
    return [file for file, least, most in manifest(path) if tokens is None or any(least <= t <= most for t in tokens)]


def read_file(path: str, file: str, tokens: frozenset | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The postings of the tokens (or all) in a file, from the row groups whose statistics allow them."""
    fs, at = _place(f"{path}/postings/{file}")
    source = pq.ParquetFile(at, filesystem=fs)
    place = source.schema_arrow.names.index("token")
    groups = []
    for g in range(source.num_row_groups):
        s = source.metadata.row_group(g).column(place).statistics
        if tokens is None or s is None or not s.has_min_max or any(s.min <= t <= s.max for t in tokens):
            groups.append(g)
    wanted = None if tokens is None else pa.array(sorted(tokens), pa.string())
    for b in source.iter_batches(row_groups=groups, columns=["token", *(c for c in columns if c != "token")]):
        if wanted is not None:
            b = b.filter(pc.is_in(b.column("token"), value_set=wanted))
        if len(b):
            yield b.select(columns)


class _File(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class PostingsReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tokens = path, columns, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and IN on the token; what is taken is applied whole. Everything else stays with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or tuple(f.attribute) != ("token",):
                yield f
            else:
                asked = frozenset(v for v in values if v is not None)
                self.tokens = asked if self.tokens is None else self.tokens & asked

    def partitions(self) -> list[InputPartition]:
        # one empty name stands for "no file", since Spark asks for a partition
        return [_File(f) for f in files_of(self.path, self.tokens)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition.file, self.tokens, self.columns) if partition.file else iter(())


class PostingsSource(DataSource):
    """spark.read.format("lexloom_postings").load(path) of an index that save() wrote."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PostingsReader:
        return PostingsReader(self.options["path"].rstrip("/"), [f.name for f in schema.fields])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The postings at path, with filters on tokens pushed down to files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PostingsSource)
    return spark.read.format(NAME).load(path)
