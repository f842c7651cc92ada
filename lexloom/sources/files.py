"""File sources and sinks: CSV, JSON, GraphML, HTML, and an SQLite import and export."""

from __future__ import annotations

import html
import json
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("season", T.IntegerType()), T.StructField("number", T.IntegerType()),
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("summary", T.StringType()),
])


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of Spark's own file systems, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def load_merged(spark: SparkSession, merged: str, merged_schema: str, sources: dict[str, str], on: str) -> DataFrame:
    """The merged file if there is one, else the sources (path to schema) left-joined in order; else an error that names them."""
    if exists(spark, merged):
        return read_csv(spark, merged, merged_schema)
    missing = [p for p in sources if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"neither {merged} nor all of its sources exist; missing: {', '.join(missing)}")
    first, *rest = (read_csv(spark, p, s) for p, s in sources.items())
    for other in rest:
        first = first.join(other, on, "left")
    return first


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A report as CSV with a header; single=False keeps the partitions for large results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines, sorted if asked; characters are not escaped."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object; value is the values' type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_query_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, query) and gold (query_id, doc_id, pos) of {"queries": [...], "answers": [[...]]}, joined by position."""
    raw = spark.read.schema("queries array<string>, answers array<array<string>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode(F.arrays_zip("queries", "answers")).alias("p", "x")).select((F.col("p") + 1).cast("long").alias("query_id"), "x.*")
    gold = rows.select("query_id", F.posexplode("answers").alias("pos", "doc_id")).select("query_id", "doc_id", (F.col("pos") + 1).cast("long").alias("pos"))
    return rows.select("query_id", F.col("queries").alias("query")), gold


def tokens_to_json(tokens: str = "tokens"):
    return F.to_json(F.col(tokens))


def tokens_from_json(column: str):
    """A JSON array of strings; null and empty give an empty array."""
    return F.coalesce(F.from_json(F.nullif(F.trim(F.col(column)), F.lit("")), "array<string>"), F.array().cast("array<string>"))


def write_table(df: DataFrame, name: str, key: str | None = None, unique: bool = False, buckets: int = 0) -> None:
    """A managed table, replaced; bucketed and sorted by key if buckets are asked for; unique checks key first."""
    if unique and df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats in {name}")
    w = df.write.mode("overwrite").format("parquet")
    (w.bucketBy(buckets, key).sortBy(key) if buckets else w).saveAsTable(name)


def export_sqlite(df: DataFrame, path: str, table: str, batch: int = 10_000) -> None:
    """A report-sized result into a local SQLite file, streamed through the driver in batches."""
    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    with sqlite3.connect(path) as con:
        con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{c}{chr(34)} {kinds.get(t, "INTEGER")}" for c, t in df.dtypes)})')
        put = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})'
        rows = []
        for r in df.toLocalIterator():
            rows.append(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r))
            if len(rows) == batch:
                con.executemany(put, rows)
                rows = []
        con.executemany(put, rows)
    con.close()


def write_corpus(docs: DataFrame, postings: DataFrame, vectors: DataFrame, prefix: str = "", buckets: int = 0) -> None:
    """The three managed tables of a corpus: documents, inverted_index(token, doc_id) and embeddings(doc_id, embedding).

    Keys are checked first, since Spark's tables enforce none: doc_id is unique and not null in documents and
    embeddings, token and doc_id are not null in the index, and both refer to documents. Any breach is an error.
    """
    for name, rows in (("documents", docs), ("embeddings", vectors)):
        if rows.filter("doc_id is null").limit(1).count():
            raise ValueError(f"a doc_id of {name} is null")
        if rows.groupBy("doc_id").count().filter("count > 1").limit(1).count():
            raise ValueError(f"a doc_id of {name} repeats")
    if postings.filter("token is null or doc_id is null").limit(1).count():
        raise ValueError("a token or doc_id of inverted_index is null")
    for name, rows in (("inverted_index", postings), ("embeddings", vectors)):
        if rows.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").limit(1).count():
            raise ValueError(f"{name} refers to a document that is not there")
    write_table(docs, f"{prefix}documents", "doc_id", buckets=buckets)
    write_table(postings, f"{prefix}inverted_index", "token", buckets=buckets)
    write_table(vectors, f"{prefix}embeddings", "doc_id", buckets=buckets)


def import_sqlite(spark: SparkSession, path: str, table: str, schema: str, part_rows: int = 100_000) -> DataFrame:
    """A table of a SQLite file that the executors can open, too, read by ranges of its row ids, a task each.

    The driver reads the least and greatest row id alone.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        first, last = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    con.close()
    wanted = T._parse_datatype_string(schema)
    if first is None:
        return spark.createDataFrame([], wanted)
    starts = spark.range(first, last + 1, part_rows, numPartitions=-(-(last + 1 - first) // part_rows))

    def rows(batches):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            for b in batches:
                for start in b["id"]:
                    found = con.execute(f'SELECT * FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(start), int(start) + part_rows))
                    while part := found.fetchmany(10_000):
                        yield pd.DataFrame(part, columns=wanted.names, dtype=object)
        con.close()

    return starts.mapInPandas(rows, wanted)


def graphml_lines(nodes: DataFrame, edges: DataFrame, node_id: str = "name") -> DataFrame:
    """(part, line): the elements of a GraphML file; part orders head, nodes, edges, tail."""
    kind = lambda t: {"bigint": "long", "int": "int", "double": "double", "float": "double"}.get(t, "string")
    clean = lambda c: _escaped(F.coalesce(c.cast("string"), F.lit("")))
    node_data = [(c, t) for c, t in nodes.dtypes if c != node_id]
    edge_data = [(c, t) for c, t in edges.dtypes if c not in ("src", "dst")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="n{i}" for="node" attr.name="{c}" attr.type="{kind(t)}"/>' for i, (c, t) in enumerate(node_data)]
    head += [f'<key id="e{i}" for="edge" attr.name="{c}" attr.type="{kind(t)}"/>' for i, (c, t) in enumerate(edge_data)]
    head.append('<graph edgedefault="directed">')
    data = lambda p, cols: [x for i, (c, _) in enumerate(cols) for x in (F.lit(f'<data key="{p}{i}">'), clean(F.col(c)), F.lit("</data>"))]
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), clean(F.col(node_id)), F.lit('">'), *data("n", node_data), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), clean(F.col("src")), F.lit('" target="'), clean(F.col("dst")), F.lit('">'), *data("e", edge_data), F.lit("</edge>")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, line string")
    return ends.unionByName(n).unionByName(e)


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One text file below path: a graph for viewing is a report."""
    graphml_lines(nodes, edges).orderBy("part", "line").coalesce(1).select("line").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, data) and (src, dst, data) of a GraphML file; data maps key ids to values."""
    key = "array<struct<_key:string,_VALUE:string>>"
    as_map = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(key)), lambda x: F.struct(x["_key"], x["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {key}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {key}").load(path)
    return nodes.select(F.col("_id").alias("id"), as_map.alias("data")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), as_map.alias("data"))


def write_network(viz_nodes: DataFrame, viz_edges: DataFrame, folder: str) -> None:
    """A presented graph of any size as JSON lines below folder/nodes and folder/edges, for viewers that load parts."""
    write_json(viz_nodes, f"{folder}/nodes")
    write_json(viz_edges, f"{folder}/edges")


def network_page(viz_nodes: DataFrame, viz_edges: DataFrame, title: str = "Entity graph", most: int = 2000) -> str:
    """A stand-alone HTML page with a searchable list of nodes in their colours and their edges.

    A page is for a graph that a browser can show: one of more than `most` nodes or edges is an error, not cut
    short. subgraph() gives the densest part of a larger one, write_network() all of it.
    """
    for what, rows in (("nodes", viz_nodes), ("edges", viz_edges)):
        if (n := rows.limit(most + 1).count()) > most:
            raise ValueError(f"more than {most} {what} ({n} or more): take a subgraph, write_network() it, or raise `most`")
    nodes = [r.asDict() for r in viz_nodes.orderBy("name").collect()]
    edges = [r.asDict() for r in viz_edges.orderBy("src", "dst", "relation").collect()]
    data = json.dumps({"nodes": nodes, "edges": edges}, default=str).replace("</", "<\\/")
    return (
        f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"
        "<input id=q placeholder=Search><div id=out></div><script>const g=" + data + ";"
        "const out=document.getElementById('out'),q=document.getElementById('q');"
        "function show(){out.textContent='';for(const n of g.nodes){if(!n.name.includes(q.value.toLowerCase()))continue;"
        "const d=document.createElement('div');d.style.color=n.color;d.style.fontSize=n.size+'px';d.textContent=n.name+' ('+n.labels+') ';"
        "for(const e of g.edges)if(e.src===n.name){const s=document.createElement('small');s.textContent=e.relation+' → '+e.dst+'; ';d.append(s)}"
        "out.append(d)}}q.oninput=show;show()</script>"
    )


