"""Words in Arrow batches: the same tokens as text.tokens(), found for a whole batch at once, and rows of words as one string.

A packed row has each word followed by a blank, which no token holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import TOKEN

_POINTS: dict[str, np.ndarray] = {}


def word_points(spark: SparkSession) -> np.ndarray:
    """For each code point whether it belongs to tokens, as the cluster's own regular expressions say."""
    app = spark.sparkContext.applicationId
    if app not in _POINTS:
        each = spark.range(0, 0x110000, 1, 4).filter("id < 55296 or id > 57343")  # no surrogates
        own = each.filter(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").rlike(f"^{TOKEN}$"))
        out = np.zeros(0x110000, bool)
        out[own.toArrow().column("id").to_numpy()] = True
        _POINTS[app] = out
    return _POINTS[app]


def _bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all rows, where each row begins and the last ends); null is empty."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)), ends - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def tokens_of(text: pa.StringArray, points: np.ndarray) -> pa.ListArray:
    """The tokens of each row of lower-case text, in order."""
    data, ends = _bytes(text)
    inside = np.append(points[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind = data[lead]
    for size, first, end, low in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        at = lead[(kind >= first) & (kind < end)]
        if len(at):
            point = (data[at] & low).astype(np.int32)
            for i in range(1, size):
                point = point << 6 | (data[at + i] & 0x3F)
            own = points[point]
            for i in range(size):
                inside[at + i] = own
    apart = np.ones(len(data) + 1, bool)  # whether no word goes on from the byte before
    apart[1:-1] = ~(inside[1:] & inside[:-1])
    apart[ends] = True
    first, last = np.flatnonzero(inside & apart[:-1]), np.flatnonzero(inside & apart[1:])
    words = _strings(data[inside], np.concatenate([[0], (last - first + 1).cumsum()]))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends).astype(np.int32)), words)
    bare = np.flatnonzero(pc.equal(words, "_").to_numpy(zero_copy_only=False))
    return without(lists, bare) if len(bare) else lists


def without(lists: pa.ListArray, at: np.ndarray) -> pa.ListArray:
    """lists, whose values begin at 0, without the values at these places."""
    keep = np.ones(len(lists.values), bool)
    keep[at] = False
    left = np.concatenate([[0], keep.cumsum()])
    return pa.ListArray.from_arrays(pa.array(left[lists.offsets.to_numpy()].astype(np.int32)), lists.values.filter(pa.array(keep)))


def packed(ends: np.ndarray, kinds: pa.StringArray, at: np.ndarray) -> pa.StringArray:
    """A row for each pair of ends: the words kinds[at], each with a blank behind it."""
    data, each = _bytes(pc.binary_join_element_wise(kinds, "", " ").take(pa.array(at)))
    return _strings(data, each[ends])


def unpacked(rows: pa.StringArray) -> pa.ListArray:
    """The words of packed rows."""
    data, ends = _bytes(rows)
    blank = data == 32
    at = np.flatnonzero(blank)
    words = _strings(data[~blank], np.concatenate([[0], at - np.arange(len(at))]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), words)


def word_lists(b: pa.RecordBatch) -> pa.ListArray:
    """The tokens of a batch of an index's rows, packed in `words` or as the list `tokens`."""
    return unpacked(b.column("words")) if "words" in b.schema.names else b.column("tokens")


def listed_words(rows: Column) -> Column:
    """unpacked() as a column."""
    return F.when(rows == "", F.array().cast("array<string>")).otherwise(F.split(F.rtrim(rows), " "))


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits of each of h that depend on all of its bits (the last steps of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit number of each word, which must not be empty; equal in all processes."""
    data, ends = _bytes(words)
    if len(ends) == 1:
        return np.empty(0, np.uint64)
    size = np.diff(ends)
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = power.cumprod(dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(ends[:-1], size)
    return mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], ends[:-1]))
