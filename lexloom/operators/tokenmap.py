"""Numbers of a vocabulary's tokens in about five bytes each, for broadcast: a static function by peeling.

After Chazelle, Kilian, Rubinfeld and Tal (2004), as in xor filters: a token's number is the exclusive or of three cells.
Tokens of the vocabulary get exactly their numbers; others get any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.words import hashes, mixed
from lexloom.storage import bounded_batches

#: Tokens of a bucket, expected; seeds tried for each.
BUCKET, TRIES = 1 << 14, 64


def _cells(h: np.ndarray, seed: np.ndarray | int, third: np.ndarray | int) -> list[np.ndarray]:
    """The three cells of each token within its bucket of 3 * third cells."""
    g = mixed(h + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    third = np.asarray(third, np.int64)
    return [(((g >> np.uint64(21 * i)) & np.uint64(0x1FFFFF)).astype(np.int64) * third >> 21) + i * third for i in range(3)]


def _peeled(cells: list[np.ndarray], size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (tokens, the cell that each has for itself), or None where some tokens share all of their cells."""
    n = len(cells[0])
    every, left, out = np.stack(cells), n, []
    count = np.bincount(every.ravel(), minlength=size)
    held = np.bincount(every.ravel(), np.tile(np.arange(n), 3).astype(float), minlength=size).astype(np.int64)
    while left:
        single = np.flatnonzero(count == 1)
        if not len(single):
            return None
        token, first = np.unique(held[single], return_index=True)
        out.append((token, single[first]))
        gone = every[:, token].ravel()
        np.subtract.at(count, gone, 1)
        np.subtract.at(held, gone, np.tile(token, 3))
        left -= len(token)
    return out


def _bucket(h: np.ndarray, value: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(third, seed, cells) of a bucket; third is 0 where two tokens have the same 64-bit hash."""
    if len(np.unique(h)) < len(h):
        return 0, 0, np.zeros(0, np.uint32)
    third = int(len(h) * 0.43) + 8
    for seed in range(TRIES):
        cells = _cells(h, seed, third)
        rounds = _peeled(cells, 3 * third)
        if rounds is None:
            continue
        table = np.zeros(3 * third, np.uint32)
        for token, own in reversed(rounds):  # its own cell is still 0
            table[own] = value[token] ^ table[cells[0][token]] ^ table[cells[1][token]] ^ table[cells[2][token]]
        return third, seed, table
    return 0, 0, np.zeros(0, np.uint32)


@dataclass(frozen=True)
class TokenMap:
    """number() of words by the cells of their buckets; bits of a hash name the bucket."""

    bits: int
    start: np.ndarray
    third: np.ndarray
    seed: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, numbers: DataFrame, size: int) -> TokenMap | None:
        """Of numbers(token, number), a row per distinct token, about `size` of them, with numbers below 2^32.

        Buckets are made by tasks, and the driver joins them. None where equal hashes leave a token without its number.
        """
        bits = max(0, -(-size // BUCKET) - 1).bit_length()

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = hashes(b.column("token"))
                yield pa.record_batch([pa.array(_bucket_of(h, bits).astype(np.int32)), pa.array(h.view(np.int64)), b.column("number")], ["bucket", "h", "number"])

        def made(t: pa.Table) -> pa.Table:
            h, value = t.column("h").to_numpy().view(np.uint64), t.column("number").to_numpy().astype(np.uint32)
            third, seed, table = _bucket(h, value)
            return pa.table({"bucket": t.column("bucket").slice(0, 1), "third": [third], "seed": [seed], "cells": pa.array([table.tobytes()], pa.binary())})

        bounded_batches(numbers.sparkSession)
        rows = numbers.select("token", F.col("number").cast("long").alias("number")).mapInArrow(dealt, "bucket int, h long, number long")
        found = rows.groupBy("bucket").applyInArrow(made, "bucket int, third long, seed long, cells binary").toArrow()
        third, seed, at = (np.zeros(1 << bits, np.int64) for _ in range(3))
        bucket = found.column("bucket").to_numpy()
        third[bucket], seed[bucket], at[bucket] = found.column("third").to_numpy(), found.column("seed").to_numpy(), np.arange(len(bucket))
        if not third[bucket].all():
            return None
        start = 3 * (third.cumsum() - third)
        table = np.zeros(max(1, int(3 * third.sum())), np.uint32)
        for b in bucket:
            cells = np.frombuffer(found.column("cells")[int(at[b])].as_buffer(), np.uint32)
            table[start[b] : start[b] + len(cells)] = cells
        return cls(bits, start, third, seed, table)

    def number(self, words: pa.StringArray) -> np.ndarray:
        h = hashes(words)
        b = _bucket_of(h, self.bits)
        cells, start = _cells(h, self.seed[b], self.third[b]), self.start[b]
        return self.table[start + cells[0]] ^ self.table[start + cells[1]] ^ self.table[start + cells[2]]


def _bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
