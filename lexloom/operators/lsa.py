"""Latent semantic vectors: a randomised truncated singular value decomposition of tf-idf rows.

Rows are documents with their tokens hashed to signed slots, at length 1. A block of random directions over the slots is
multiplied by the rows and back (A'A X) in passes over the table: a task keeps its rows, adds up its part of the block,
and the parts are summed level by level. The driver makes each block orthogonal to those before (a block Krylov space,
after Musco and Musco 2015) and solves for the values inside that space; what it holds is fixed: slots x directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches, cut, shuffles_go

from .index import Index, weighed
from .vector import hash_slots, index_sums

#: Slots of tokens, directions of a pass, passes at most, and the change of a singular value that ends them.
SLOTS, WIDTH, PASSES, TOLERANCE = 1 << 16, 32, 12, 1e-5
#: Slots in a row of the block between tasks; parts that one task sums; entries of rows that are multiplied at once.
CHUNK, FAN, ENTRIES = 1024, 32, 1 << 15
#: Cells (rows x slots that they have) up to which a group of rows is multiplied as a dense matrix.
CELLS = 1 << 22
#: Singular values below this part of the largest belong to no direction.
LEAST = 1e-3


def rows(terms: DataFrame, idf: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """(key, slots, weights) of terms(key, token, f): the sums of f * idf^2 by signed slot, sorted by slot, at length 1.

    The square weighs rare tokens, by which a passage is known, above those that make up most of a text.

    Rows without a known token, or whose sums are all 0, have no entry and are left out.
    """
    hashed = weighed(terms.select(key, "token", "f"), hash_slots(idf, slots))
    summed = hashed.groupBy(key, "slot").agg(F.sum(F.col("f") * F.col("idf") * F.col("idf") * F.col("sign")).alias("w")).filter("w != 0")
    size = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size")
    one = summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("x"), size)
    return one.select(key, F.transform("x", lambda e: e["slot"].cast("int")).alias("slots"), F.transform("x", lambda e: (e["w"] / F.col("size")).cast("float")).alias("weights"))


def index_rows(index: Index, slots: int = SLOTS) -> DataFrame:
    """rows() of an index's documents, from its forward rows where it has them."""
    if index.forward is None:
        return rows(index.tf, index.idf, "doc_id", slots)
    one = index_sums(index, slots, 2).filter("norm > 0")
    one = one.select("doc_id", F.filter("slots", lambda e: e["w"] != 0).alias("x"), "norm")
    return one.select("doc_id", F.transform("x", lambda e: e["slot"].cast("int")).alias("slots"), F.transform("x", lambda e: (e["w"] / F.col("norm")).cast("float")).alias("weights"))


def entries(b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each entry from 0, slots, weights) of a batch, about ENTRIES entries at a time."""
    slots, weights = b.column("slots"), b.column("weights")
    size = np.diff(slots.offsets.to_numpy())
    flat, w = slots.flatten().to_numpy(), weights.flatten().to_numpy()
    ends = size.cumsum()
    group = (ends - size) // ENTRIES
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        lo, hi = ends[own[0]] - size[own[0]], ends[own[-1]]
        yield slice(own[0], own[-1] + 1), np.repeat(np.arange(len(own)), size[own]), flat[lo:hi], w[lo:hi]


def times(x: np.ndarray, row: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rows' product with x; every row has an entry, and entries of a row stand together."""
    return np.add.reduceat(x[slots] * weights[:, None], np.flatnonzero(np.diff(row, prepend=-1)))


def add_squared(total: np.ndarray, x: np.ndarray, row: np.ndarray, slots: np.ndarray, weights: np.ndarray, room: np.ndarray) -> None:
    """Add A'A x of a group's rows A to total; room: CELLS zeros, which come back as zeros.

    The group's own slots make a dense matrix, for which products are fastest; where that has more than CELLS cells, as
    with many short rows, entries are multiplied one by one.
    """
    seen = np.zeros(len(x), bool)
    seen[slots] = True
    own = np.flatnonzero(seen)
    if (int(row[-1]) + 1) * len(own) > len(room):
        y = times(x, row, slots, weights)
        order = np.argsort(slots, kind="stable")
        first = np.flatnonzero(np.diff(slots[order], prepend=-1))
        total[own] += np.add.reduceat(y[row[order]] * weights[order][:, None], first)
        return
    place = np.cumsum(seen, dtype=np.int32) - 1
    cell = row * len(own) + place[slots]
    room[cell] = weights
    a = room[: (int(row[-1]) + 1) * len(own)].reshape(-1, len(own))
    total[own] += a.T @ (a @ x[own])
    room[cell] = 0


def few(table: DataFrame) -> DataFrame:
    """table in two parts per core at most: each part sums a whole block, whatever it has of rows, which stream through it."""
    return table.coalesce(2 * table.sparkSession.sparkContext.defaultParallelism)


def _squared(table: DataFrame, x: np.ndarray, parts: int) -> np.ndarray:
    """A'A x over the rows A of the table, by one pass and a tree of sums."""
    sent, slots, width = table.sparkSession.sparkContext.broadcast(x), *x.shape
    schema = "chunk int, part long, block binary"

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, row, at, w in entries(b):
                if total is None:
                    total, room = np.zeros((slots, width), np.float32), np.zeros(CELLS, np.float32)
                add_squared(total, sent.value, row, at, w, room)
        if total is not None:
            for c in range(0, slots, CHUNK):
                block = total[c : c + CHUNK]
                if block.any():
                    yield pa.record_batch([pa.array([c // CHUNK], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([block.tobytes()], pa.binary())], ["chunk", "part", "block"])

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = np.zeros(len(t.column("block")[0].as_py()) // 4, np.float64)
        for block in t.column("block"):
            total += np.frombuffer(block.as_py(), np.float32)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()), "block": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    blocks = table.select("slots", "weights").mapInArrow(added, schema)
    while parts > 1:
        blocks = blocks.groupBy("chunk", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(summed, schema)
        parts = -(-parts // FAN)
    with shuffles_go(table.sparkSession):
        found = blocks.select("*").collect()
    sent.destroy()
    out = np.zeros((slots, width))
    for r in found:
        block = np.frombuffer(bytes(r["block"]), np.float32).reshape(-1, width)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(block)] += block
    return out


@dataclass(frozen=True)
class Lsa:
    """basis [slots, dim]: the right singular vectors; values: the singular values, falling; passes that they took."""

    basis: np.ndarray
    values: np.ndarray
    passes: int = 0

    @classmethod
    def fit(cls, table: DataFrame, dim: int = 64, slots: int = SLOTS, seed: int = 3) -> Lsa:
        """Of rows(): passes until no wanted value changes by more than TOLERANCE of the largest, PASSES at most.

        Fewer directions come out where the rows have fewer.
        """
        bounded_batches(table.sparkSession)
        table = few(table.select("slots", "weights"))
        parts = table.rdd.getNumPartitions()
        x = np.linalg.qr(np.random.default_rng(seed).normal(size=(slots, min(slots, max(WIDTH, -(-2 * dim // PASSES))))))[0]
        space, inner, values, done = np.empty((slots, 0)), np.empty((0, 0)), np.zeros(0), 0
        for done in range(1, PASSES + 1):
            z = _squared(table, x.astype(np.float32), parts)
            space = np.concatenate([space, x], axis=1)
            new = space.T @ z
            inner = np.block([[inner, new[: len(inner)]], [new[: len(inner)].T, new[len(inner) :]]])
            squares, turn = np.linalg.eigh((inner + inner.T) / 2)
            before, values = values, np.sqrt(np.maximum(squares[::-1][:dim], 0))
            basis = space @ turn[:, ::-1][:, :dim]
            if len(before) == len(values) == dim and np.abs(values - before).max() <= TOLERANCE * values.max():
                break
            for _ in range(2):  # twice, for what rounding leaves
                z = z - space @ (space.T @ z)
            x, r = np.linalg.qr(z)
            x = x[:, np.abs(np.diag(r)) > (LEAST * values.max(initial=0)) ** 2]
            if not x.shape[1] or space.shape[1] + x.shape[1] > slots:
                break
        live = int((values > LEAST * values.max(initial=1e-300)).sum())
        return cls(basis[:, :live].astype(np.float32), values[:live], done)

    def embed(self, table: DataFrame, key: str) -> DataFrame:
        """(key, embedding): the rows' coordinates along the singular vectors, each over the square of its value, at length 1.

        So directions that most documents share count little; passages find the documents that hold them by the others.
        """
        bounded_batches(table.sparkSession)
        sent = table.sparkSession.sparkContext.broadcast((self.basis / self.values**2).astype(np.float32))
        dim = self.basis.shape[1]

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, row, slots, weights in entries(b):
                    y = times(sent.value, row, slots, weights).astype(float)
                    size = np.sqrt((y * y).sum(axis=1, keepdims=True))
                    y = np.divide(y, size, out=np.zeros_like(y), where=size > 0)
                    lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * dim, y.ravel())
                    yield pa.record_batch([b.column(key).slice(part.start, len(y)), lists], [key, "embedding"])

        kind = table.schema[key].dataType.simpleString()
        return table.select(key, "slots", "weights").mapInArrow(made, f"{key} {kind}, embedding array<double>")

    def save(self, path: str, spark: SparkSession) -> None:
        """One row: the basis has slots x dim entries, whatever the corpus is."""
        row = [(self.basis.tobytes(), list(self.basis.shape), self.values.tolist(), self.passes)]
        spark.createDataFrame(row, "basis binary, shape array<int>, values array<double>, passes int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lsa:
        r = spark.read.parquet(path).first()
        return cls(np.frombuffer(bytes(r["basis"]), np.float32).reshape(r["shape"]), np.array(r["values"]), r["passes"])
