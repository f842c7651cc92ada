"""Embedding whitening: exact integer means, blockwise TSQR of the centred rows, one-sided Jacobi on R."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries at or beyond this have no place among 64-bit integers once scaled; their vectors take no part.
LARGEST = 2.0**55
#: R factors that one task stacks, and rows of a block.
FAN, BLOCK_ROWS = 16, 4096
#: Columns of a vector at most: the driver and each merging task hold FAN matrices of that order.
MOST_COLUMNS = 4096
SWEEPS = 60


def usable(vector: Column) -> Column:
    """Whether every entry is a finite number below LARGEST, and there is one; false for null."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))  # noqa: E731  NaN is above all numbers
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of dim numbers each as the rows of a matrix of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def integers(lists: pa.Array, dim: int) -> np.ndarray:
    return np.floor(SCALE * matrix(lists, dim)).astype(np.int64) + SHIFT


def exact(values: np.ndarray, factor: int = 1) -> np.ndarray:
    """values as 64-bit integers where sums of factor times their size fit into these, else as Python's integers."""
    most = max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
    return values if most * factor < 2**62 else values.astype(object)


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S): number and exact sums by dimension of rows(embedding) whose size is the most frequent one, ties to the smaller."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            lists = b.column("embedding")
            sizes = pc.list_value_length(lists)
            for dim in pc.unique(sizes).to_pylist():
                x = integers(lists.filter(pc.equal(sizes, dim)), dim)
                n, sums = found.get(dim, (0, 0))
                found[dim] = (n + len(x), sums + exact(x, len(x)).sum(axis=0).astype(object))
        for dim, (n, sums) in found.items():
            total = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.record_batch([pa.repeat(pa.scalar(dim, pa.int32()), dim), pa.array(range(dim), pa.int32()), pa.repeat(pa.scalar(n, pa.int64()), dim), total], ["dim", "at", "n", "total"])

    sums = rows.mapInArrow(partial, "dim int, at int, n long, total decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_dim: dict[int, list] = {}
    for r in sums.collect():  # one row per dimension
        by_dim.setdefault(r["dim"], []).append(r)
    if not by_dim:
        return 0, []
    dim = min(by_dim, key=lambda d: (-by_dim[d][0]["n"], d))
    if dim > MOST_COLUMNS:
        raise ValueError(f"vectors of {dim} entries; at most {MOST_COLUMNS}")
    return by_dim[dim][0]["n"], [int(r["total"]) for r in sorted(by_dim[dim], key=lambda r: r["at"])]


def factor(rows: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of rows."""
    return np.linalg.qr(rows, mode="r")


def tsqr(rows: DataFrame, prepared, columns: int) -> np.ndarray:
    """R of all rows(embedding) together, of which prepared(lists) makes a matrix of that many columns.

    Every task reduces its blocks to one R; groups of FAN are stacked and factorised again, level by level, so that
    no task holds more than FAN of them and the driver gets the last one.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, columns))
        for b in batches:
            x = prepared(b.column("embedding"))
            for i in range(0, len(x), BLOCK_ROWS):
                r = factor(np.vstack([r, x[i : i + BLOCK_ROWS]]))
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["block", "r"])

    def merged(t: pa.Table) -> pa.Table:
        stack = [np.asarray(r).reshape(-1, columns) for r in t.sort_by("block").column("r").to_pylist()]
        return pa.table({"block": pa.array([t.column("block")[0].as_py() // FAN], pa.int64()), "r": pa.array([factor(np.vstack(stack)).ravel()], pa.list_(pa.float64()))})

    schema, blocks = "block long, r array<double>", rows.select("embedding").mapInArrow(reduced, "block long, r array<double>")
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("block") / FAN).alias("group")).applyInArrow(merged, schema)
        parts = -(-parts // FAN)
    found = blocks.collect()
    return np.array(found[0]["r"]).reshape(-1, columns) if found else np.zeros((0, columns))


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of disjoint pairs, as in a tournament."""
    seats = list(range(n)) + [-1] * (n % 2)
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :])) if min(a, b) >= 0]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, s) of R = U diag(s) V': plane rotations of pairs of columns until all are orthogonal; s falls.

    The rotations of a round touch disjoint pairs and are made together. A pair counts as orthogonal when its cosine is
    below the precision of doubles, so that small singular values keep their relative accuracy. The accumulated
    rotations are V; the norms of the columns are s.
    """
    a, eps = np.array(r, float), np.finfo(float).eps
    by_norm = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    a, v = a[:, by_norm], np.eye(a.shape[1])[:, by_norm]
    rounds = _rounds(a.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > eps * np.sqrt(xx) * np.sqrt(yy)
            if not turn.any():
                continue
            turned, p, q, x, y, xx, yy, xy = True, p[turn], q[turn], x[:, turn], y[:, turn], xx[turn], yy[turn], xy[turn]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    s = np.linalg.norm(a, axis=0)
    falling = np.argsort(-s, kind="stable")
    return v[:, falling], s[falling]


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the fit list; components as columns by falling variance, with their standard deviations.

    Components without variance (beyond the precision of doubles) whiten nothing: their results are null.
    """

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: list[float | None]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def own(self, rows: DataFrame) -> DataFrame:
        """The rows that take part."""
        return rows.filter(usable(F.col("embedding")) & (F.size("embedding") == self.dim))

    def offsets(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(x - floor(S / n), S - n floor(S / n)), exact: small integers, whatever the mean is."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return integers(lists, self.dim) - whole, np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, lists: pa.Array) -> np.ndarray:
        y, rest = self.offsets(lists)
        return y - rest / self.n

    def spread(self, lists: pa.Array) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact, as Python's integers."""
        y, rest = self.offsets(lists)
        y = exact(y, self.dim * max(int(np.abs(y).max(initial=0)), int(rest.max(initial=0)), 1))
        squares, mixed = (y * y).sum(axis=1), (y * rest).sum(axis=1)
        last = sum(int(r) ** 2 for r in rest)
        return [self.n**2 * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, mixed)]

    def whitened(self, lists: pa.Array, live: int) -> np.ndarray:
        """The first `live` components of the rows, in units of their standard deviations."""
        return self.centred(lists) @ self.components[:, :live] / self.deviations[:live]

    @property
    def live(self) -> int:
        """Components with a variance."""
        return int((self.deviations > self.dim * np.finfo(float).eps * self.deviations.max(initial=0)).sum())


def fit(vectors: DataFrame) -> Whitening:
    """Whitening of vectors(embedding): two passes, one for the exact means and one for R of the centred rows."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select("embedding").filter(usable(F.col("embedding")))
    n, sums = moments(rows)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), [])
    bare = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), [])
    v, s = jacobi(tsqr(bare.own(rows), bare.centred, len(sums)))
    variance = s * s / n
    total = variance.sum()
    return Whitening(n, sums, v, s / np.sqrt(n), [float(e / total) if total else None for e in variance])


def identity_error(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with a variance.

    The covariance comes from TSQR too: behind a column of ones, R holds the factor of the centred rows.
    """
    live = min(components, model.live)
    if not live:
        return None
    with_ones = lambda lists: np.column_stack([np.ones(len(lists)), model.whitened(lists, live)])
    r = tsqr(model.own(vectors.select("embedding")), with_ones, live + 1)[1:, 1:]
    return float(np.abs(r.T @ r / model.n - np.eye(live)).max())


def transform(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation decimal(38,0), whitened array<double> (null without variance) of the rows that take part."""
    wanted, live = min(components, model.dim), min(components, model.live)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            w = np.full((len(lists), wanted), np.nan)
            w[:, :live] = model.whitened(lists, live)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * wanted), flat)
            spread = pa.array([Decimal(d) if d < 10**38 else None for d in model.spread(lists)], pa.decimal128(38, 0))
            yield pa.record_batch([b.column("vec_id"), spread, out], ["vec_id", "deviation", "whitened"])

    own = model.own(vectors.select("vec_id", "embedding"))
    schema = f"vec_id {own.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return own.mapInArrow(rows, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component, from 1.

    vectors(vec_id, embedding); other columns are not read. A vector that is null or empty, holds null, NaN or an
    infinity, or an entry from LARGEST on takes no part, nor does one whose number of entries is not the most frequent
    (ties: the smaller). Rows repeat as they are given, those of one id or without an id included; equal vectors get
    equal rows, up to rounding. deviation is null where it exceeds a long (the model's spread() is exact). Where a component has no
    variance, as for one vector or equal ones, whitened is null; where none has, explained and identity_error are null
    too. Equal variances keep the order that the rotations leave. Empty table: empty result. The fit runs when the
    frame is made: three passes over the vectors, the result is the fourth.
    """
    model = fit(vectors)
    if not model.n:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, model, components)
    share = F.array(*(F.lit(e).cast("double") for e in model.explained[:components]))
    each = transform(vectors, model, components).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
