"""Centroid clustering: Lloyd rounds over distinct quantised vectors, weighted by how often each occurs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches, cut

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Entries at or beyond this could have squared distances beyond 64 bits; their vectors take no part.
LARGEST = 2.0**20
#: Vectors that are at least this part of all are broadcast with their assignment: no more than that many exist.
HOT_PART = 1024


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, q: floor(scale * x) of the vectors with dim entries, all finite."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))  # noqa: E731  NaN is above all numbers
    whole = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("int"))
    ok = (F.size("embedding") == dim) & F.forall("embedding", fits)
    return vectors.filter(F.coalesce(ok, F.lit(False))).select("vec_id", whole.alias("q"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:vec_id, in that order; a null id hashes as 'null', ties by vector."""
    place = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    found = rows.select(place.alias("place"), "q").orderBy("place", "q").limit(k).collect()
    return np.array([r["q"] for r in found], np.int64)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    q = b.column("q")
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(q), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, exact; ties go to the smaller number."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0), 1)
    kind = np.float64 if float(most) ** 2 * 4 * x.shape[1] < 2**53 else np.int64  # whole doubles are exact there
    a, c = x.astype(kind), centroids.astype(kind)
    far = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at].astype(np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: componentwise exact floors of the weighted means; those without vectors stay."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
        for b in batches:
            x, m = _rows(b), b.column("m").to_numpy()
            if float(np.abs(x).max(initial=0)) * float(m.sum()) >= 2**62:
                x, m = x.astype(object), m.astype(object)
            at, _ = nearest(x.astype(np.int64), centroids)
            for c in np.unique(at):
                own = at == c
                count[c] += int(m[own].sum())
                sums[c] += (x[own] * m[own, None]).sum(axis=0).astype(object)
        some = [c for c in range(len(centroids)) if count[c]]
        if some:
            flat = [Decimal(int(s)) for c in some for s in (count[c], *sums[c])]
            each = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * (centroids.shape[1] + 1), pa.array(flat, pa.decimal128(38, 0)))
            yield pa.record_batch([pa.array(some, pa.int32()), each], ["cluster", "sums"])

    parts = distinct.mapInArrow(partial, "cluster int, sums array<decimal(38,0)>").select("cluster", F.posexplode("sums").alias("at", "part"))
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("part").alias("total")).collect():  # centroids x dimensions
        found.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
    out = centroids.copy()
    for c, own in found.items():
        out[c] = [own[i + 1] // own[0] for i in range(centroids.shape[1])]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct(q, m) with cluster and distance."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = nearest(_rows(b), centroids)
            yield pa.record_batch([b.column("q"), b.column("m"), pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["q", "m", "cluster", "distance"])

    return distinct.mapInArrow(near, "q array<int>, m long, cluster int, distance long")


def labelled(rows: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """rows(vec_id, q) with the cluster and distance of their vector in labels(q, m, cluster, distance).

    A vector that makes up a HOT_PART-th of all rows or more meets its rows by a broadcast (at most HOT_PART vectors),
    so that copies without number are not sent to one task; the others meet in a shuffled join.
    """
    hot = F.col("m") * HOT_PART >= total
    often = F.broadcast(labels.filter(hot).drop("m"))
    rare = rows.join(often.select("q"), "q", "left_anti").join(labels.filter(~hot).drop("m"), "q")
    return rows.join(often, "q").unionByName(rare)


SCHEMA = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors(vec_id, embedding).

    Equal quantised vectors are counted once, with partial counts before the shuffle; each round reads the distinct
    ones and sums them by cluster with their multiplicities, as integers. The centroids (k x dim numbers) are all
    that the driver gets. A vector that is null, holds null, NaN, an infinity or an entry from LARGEST on, or has
    another number of entries takes no part. Rows of equal ids, or without an id, are vectors of their own. With fewer
    vectors than k there are as many centroids as vectors. Equal distances go to the smaller number. Inertias beyond
    a long are null. Empty table: empty result. Other columns are not read. The rounds run when the frame is made.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = kept(vectors.select("vec_id", "embedding"), dim, scale)
    distinct = cut(rows.groupBy("q").agg(F.count("*").alias("m")), "distinct")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    labels = cut(assigned(distinct, centroids), "assigned")
    spent = labels.groupBy("cluster").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("decimal(38,0)") * F.col("distance")).alias("inertia")).collect()
    total, own = sum(r["n"] for r in spent), {r["cluster"]: int(r["inertia"]) for r in spent}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda x: F.lit(x if x is not None and x < 2**63 else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    each = of([fits(own.get(i)) for i in range(len(centroids))])
    return labelled(rows, labels, total).select("vec_id", "cluster", "distance", each.alias("cluster_inertia"), fits(sum(own.values())).alias("inertia"), of([F.lit(d) for d in digest]).alias("centroid_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def oracle() -> str:
    """DuckDB SQL for the rows of query(): the rounds one after the other, over every vector."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS (SELECT r, c, sum((y - z) * (y - z))::BIGINT AS distance FROM v JOIN c{i} USING (i) GROUP BY r, c),
    a{i} AS MATERIALIZED (SELECT r, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, c) AS place FROM d{i}) WHERE place = 1)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT c, i, sum(y)::HUGEINT AS s, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY c, i),
    c{i + 1} AS MATERIALIZED (SELECT c, i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, z) AS z FROM c{i} LEFT JOIN s{i} USING (c, i))""")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM}
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {LARGEST})) = {DIM}),
    v AS MATERIALIZED (SELECT r, unnest(range({DIM})) AS i, floor({SCALE}::DOUBLE * unnest(embedding)::DOUBLE)::BIGINT AS y FROM k),
    f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM k QUALIFY c < {CENTROIDS}),
    c0 AS MATERIALIZED (SELECT c, i, y AS z FROM f JOIN v USING (r)),
    {', '.join(steps)},
    g AS (SELECT c, sha256(string_agg(z::VARCHAR, ',' ORDER BY i)) AS digest FROM c{ROUNDS} GROUP BY c)
    SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
    FROM a{ROUNDS} JOIN k USING (r) JOIN g USING (c)"""
