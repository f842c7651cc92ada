"""N-gram Jaccard self-join by prefix trees, and the connected components of its links.

A text's set holds the 64-bit hashes of its distinct word n-grams. All sets are ordered by one global order: the
estimated frequency of an n-gram in the corpus (a count sketch over every n-gram of every text, of fixed size and
broadcast), then its hash. The order decides speed only; any fixed order gives exact results.

1. Candidates. Two sets of Jaccard similarity t share an n-gram among the rarest |x| - ceil(t |x|) + 1 of each
   (prefix filter), and their sizes lie in neighbouring bands of ratio t. So sets meet under (n-gram, band); the
   smallest set id there is the hub, and what is kept is (hub, set), not pairs: a group of g sets gives g rows.
   N-grams whose estimate, an upper bound of their count, is at most COLD are grouped in one shuffle; for the
   others only minima and maxima are aggregated, partially before the shuffle, and joined back.
   Then sets whose parity bitmaps rule out every partner under the hub leave it (the bits that differ between two
   bitmaps are at most as many as the n-grams that differ between the sets), and the sets that stay are gathered.
2. Trees. All sets of a hub meet in blocks of bounded size. A block is a compressed trie, frequent n-grams first, so
   that near copies share long paths. A set walks the trie with the overlap so far; a subtree ends when the
   overlap, plus what is left of the set or of the subtree's longest set, cannot reach what its smallest set needs,
   and when all its sets are already connected with the walking set. Verified links of a spanning forest come out.
   Where a hub has several blocks and sets that are not connected with it in their block, its sets meet again in
   smaller groups: linked sets share l n-grams among the rarest |x| - ceil(t |x|) + l of each, so with l - 1 n-grams
   set aside they still share one. Only groups that hold an unconnected set are formed. After SPLITS such rounds the
   unconnected sets of groups that are still large walk the other blocks.
3. Components by alternating large-star and small-star steps over the links, on the executors.

Equal sets have one 128-bit fingerprint and are one node throughout.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches, cut, discard, same_table, shuffles_go

from .memory import released

#: Bits of the sketch: of at least SKETCH_BITS, growing with the rows, up to a broadcast of 32 MB.
SKETCH_BITS, SKETCH_MOST, SLICES = 23, 25, 16
#: Occurrences up to which the rows of an n-gram may meet in one task.
COLD = 4096
#: Bits of the filter that picks the sets to gather (some others pass, and the join drops them): at least FILTER_BITS,
#: eight per row, up to a broadcast of 128 MB.
FILTER_BITS, FILTER_MOST = 25, 30
#: Bits of the filter that passes n-grams of several sets: eight per row of the prefixes, up to a broadcast of 32 MB.
TOKEN_BITS, TOKEN_MOST = 23, 28
#: Sets and n-grams under one hub up to which the bitmap filter works; larger hubs keep all their sets.
FILTER_SETS, FILTER_GRAMS = 1 << 13, 1 << 27
#: Sets that a task remembers, in order to send on one copy of each.
SEEN = 1 << 16
#: N-grams in a block, expected.
BLOCK_GRAMS = 1 << 19
#: Rounds in which the sets of large hubs meet again in smaller groups.
SPLITS = 2
#: Share of all rows from which on copies of a text count as a hot group; there are at most this many of them.
HOT_GROUPS = 4096
_CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240301)
#: A random number for each byte at each of the first places of a word; farther ones are mixed from byte and place.
_PLACES = 64
_AT = _RNG.integers(0, 1 << 64, (_PLACES, 256), dtype=np.uint64).ravel()
_MIX = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 1 << 64, 64, dtype=np.uint64)]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ of the bytes, A-Z lower-cased: the sum of a random number per byte and place.

    Such sums have no structure that words could share; a polynomial modulo 2^64 has (Thue-Morse words collide in any base).
    """
    raw = np.frombuffer(data.lower(), np.uint8)
    out = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK_BYTES)
        if end < len(raw):  # to the end of a word, however long
            more = np.flatnonzero(_BLANK[raw[end : end + _CHUNK_BYTES]])
            while not len(more) and end < len(raw):
                end = min(len(raw), end + _CHUNK_BYTES)
                more = np.flatnonzero(_BLANK[raw[end : end + _CHUNK_BYTES]])
            end += int(more[0]) if len(more) else 0
        part = raw[at:end]
        blank = _BLANK[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        if len(start):
            place = np.arange(len(part), dtype=np.int32)
            place -= np.repeat(np.concatenate([[0], start]).astype(np.int32), np.diff(np.concatenate([[0], start, [len(part)]])))
            far = np.flatnonzero(place >= _PLACES)
            beyond = place[far].astype(np.uint64)
            np.minimum(place, _PLACES - 1, out=place)
            place *= 256
            place += part
            value = _AT[place]
            value[far] = _mixed(_mixed(beyond) ^ value[far])
            value[blank] = 0
            out.append(_mixed(np.add.reduceat(value, start) + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def gram_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams; with fewer words, of the whole sequence; empty without words."""
    w = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    if len(w) < k:
        h = np.array([len(w)], np.uint64)
        for i in range(len(w)):
            h = _mixed(h * _MIX[-1] + w[i : i + 1] * _MIX[i])
        return h
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i : i + len(h)] * _MIX[i]
    return np.unique(_mixed(h))


def fingerprint(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def node_id(fp: bytes) -> int:
    """A short name of a set for the candidate search. Sets that share one are gathered together and told apart there."""
    return int.from_bytes(fp[:5], "big")


def _node(fp: str):
    """node_id() as a native expression."""
    return F.conv(F.hex(F.substring(fp, 1, 5)), 16, 10).cast("long")


def bits_for(rows: int, least: int, most: int, each: int) -> int:
    """Bits of a structure of `each` positions per row, within bounds."""
    return max(least, min(most, (max(1, rows) * each - 1).bit_length()))


def bucket(grams: np.ndarray, size: int) -> np.ndarray:
    """Positions in a sketch of a size that is a power of two."""
    return ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def parity(grams: np.ndarray) -> np.ndarray:
    """Bitmap (bytes of 0 and 1) of the parity of the n-grams per position; from 256 bits on, at least n / 2 bits."""
    bits = max(256, 1 << max(0, (len(grams) - 1).bit_length() - 1))
    return (np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


def folded(packed: np.ndarray, size: int) -> np.ndarray:
    """A packed bitmap folded to size bytes; positions are taken modulo its length, so parities add up."""
    while len(packed) > size:
        packed = packed[: len(packed) // 2] ^ packed[len(packed) // 2 :]
    return packed


def partners(n: np.ndarray, bitmaps: list[bytes], first: int, num: int, den: int) -> np.ndarray:
    """Which sets may link with another one, by sizes and bitmaps; set `first` is tried before the others."""
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    width = min(map(len, bitmaps))
    maps = [np.frombuffer(b, np.uint8) for b in bitmaps]
    coarse = np.stack([folded(m, width) for m in maps])[order]
    may = np.zeros(len(n), bool)

    def tried(i: int, others: np.ndarray) -> np.ndarray:
        """Of the positions others, those that may link with position i."""
        others = others[(den * sizes[others] >= num * sizes[i]) & (den * sizes[i] >= num * sizes[others]) & (others != i)]
        allowed = (sizes[others] + sizes[i]) * (den - num) // (den + num)
        differ = np.bitwise_count(coarse[others] ^ coarse[i]).sum(axis=1, dtype=np.int64)
        others, allowed = others[differ <= allowed], allowed[differ <= allowed]
        out = []
        for j, most in zip(others, allowed):
            a, b = maps[order[i]], maps[order[j]]
            size = min(len(a), len(b))
            if size == width or int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= most:
                out.append(j)
        return np.array(out, np.int64)

    every = np.arange(len(n))
    at = int(np.flatnonzero(order == first)[0])
    hit = tried(at, every)
    may[hit] = True
    may[at] = len(hit) > 0
    for i in every:
        if not may[i]:
            hit = tried(int(i), every)
            may[hit] = True
            may[i] = len(hit) > 0
    out = np.zeros(len(n), bool)
    out[order] = may
    return out


def streamed(df: DataFrame, keys: tuple[str, ...], f, schema: str) -> DataFrame:
    """f(columns of a group as lists by name) -> rows, for every group of keys, with many small groups per batch.

    The rows are dealt and sorted by the keys; a task holds a batch, one group and the rows that it gives out.
    """
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    out_schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def done() -> list[tuple]:
            return f(dict(zip(columns, map(list, zip(*held))))) if held else []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), out_schema.types)], schema=out_schema)

        for b in batches:
            lists = [b.column(c).to_pylist() for c in columns]
            for row in zip(*lists):
                now = tuple(row[columns.index(k)] for k in keys)
                if now != key:
                    out += done()
                    key, held = now, []
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                held.append(row)
        out += done()
        if out:
            yield batch(out)
        released()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids a packed filter has, others that share a place with one of these included."""
    at = ids & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _texts(batch: pa.RecordBatch, leading: np.ndarray | None = None) -> Iterator[str | None]:
    """The texts of a batch, one at a time; with a filter of ids, of the rows whose id it has or that have none."""
    column = batch.column("text")
    at = np.arange(len(column))
    if leading is not None:
        ids = batch.column("doc_id")
        at = at[_has(leading, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)]
    return (column[int(i)].as_py() for i in at)


def fingerprints(docs: DataFrame, k: int, size: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, fp, bits) of every row, parts (slice, blob) of every task of a sketch of that size); one pass, written to the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("bits", pa.binary()), ("slice", pa.int32()), ("blob", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for b in batches:
            n, fp, bits = [], [], []
            for text in _texts(b):
                grams = gram_set(text, k)
                n.append(len(grams))
                bits.append(np.packbits(parity(grams)).tobytes())
                fp.append(fingerprint(grams))
                np.add.at(counts, bucket(grams, size), np.uint32(1))
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bits, pa.binary()), *none], schema=schema)
        # the four bytes of all counts apart: the upper ones are nearly all 0
        parts = [zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in counts.reshape(SLICES, -1)]
        none = pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.binary())
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)
        released()

    both = cut(docs.mapInArrow(made, "doc_id long, n long, fp binary, bits binary, slice int, blob binary"), "fingerprints")
    return both.filter("slice is null").select("doc_id", "n", "fp", "bits"), same_table(both.filter("slice is not null").select("slice", "blob"), both)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, 8 times the binary logarithm, rounded up: a level never stands for less than its count."""
    return np.minimum(255, np.ceil(8 * np.log2(1.0 + counts))).astype(np.uint8)


def frequencies(parts: DataFrame, size: int) -> np.ndarray:
    """The corpus's sketch as one byte per bucket, 8 times the binary logarithm; each slice is summed as it streams."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b["slice"], b["blob"]):
                counts = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                total[s] = total.get(s, 0) + counts.astype(np.uint64)
        if total:
            level = [level_of(t).tobytes() for t in total.values()]
            yield pd.DataFrame({"slice": list(total), "level": level})
        released()

    # a slice streams through one task, whatever the number of parts; it holds the sums only
    with shuffles_go(parts.sparkSession):
        found = parts.repartition(SLICES, "slice").mapInPandas(summed, "slice int, level binary").collect()
    out, own = np.zeros(size, np.uint8), size // SLICES
    for r in found:
        out[r["slice"] * own : (r["slice"] + 1) * own] = np.frombuffer(r["level"], np.uint8)
    return out


#: The largest size that prefixes() tells from larger ones.
MOST = (1 << 23) - 1


def prefixes(docs: DataFrame, k: int, num: int, den: int, order, leading) -> DataFrame:
    """(token, set, hot): the rarest n-grams of each set, as many as the prefix filter needs; copies that do not lead
    their set are passed over, and copies in a batch count once.

    Of two linked sets the smaller shares one of its first |x| - ceil(2t / (1 + t) |x|) + 1 with the longer prefix
    of the larger; early marks these, and an n-gram that is early for no set brings no sets together. set packs the
    set's node_id (40 bits), its size (23 bits; sizes beyond count as the largest, which only lets more sets meet)
    and early (1 bit), since these rows are most of what the join shuffles.
    """
    schema = pa.schema([("token", pa.int64()), ("set", pa.int64()), ("hot", pa.bool_())])
    warm = level_of(np.array([COLD]))[0]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        for b in batches:
            seen, tokens, sets, hot, held = set(), [], [], [], 0
            for text in _texts(b, leading.value):
                grams = gram_set(text, k)
                n = len(grams)
                if not n or (nid := node_id(fingerprint(grams))) in seen:
                    continue
                seen.add(nid)
                first = n - -(-num * n // den) + 1
                often = level[bucket(grams, len(level))]
                at = np.argsort(often, kind="stable")[:first]  # grams ascend: ties by hash
                rare = grams[at] >> np.uint64(16)  # shorter names of n-grams: those that share one meet more than they must
                hot.append(often[at] > warm)
                tokens.append(rare.view(np.int64))
                early = np.arange(first) < n - -(-2 * num * n // (den + num)) + 1
                sets.append((np.uint64(nid << 24 | min(n, MOST) << 1) | early.astype(np.uint64)).view(np.int64))
                held += first
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sets, hot)], schema=schema)
                    tokens, sets, hot, held = [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sets, hot)], schema=schema)
        released()

    return docs.select("doc_id", "text").mapInArrow(made, "token long, set long, hot boolean")


def repeated(listed: DataFrame, bits_: int) -> np.ndarray:
    """A filter of 2^bits_ positions, packed, that has each token of two or more rows of listed(token, ...).

    Most of the rarest n-grams are of one set alone and bring none together. A task marks the places that it has met once
    and more often; per slice these are added up as they stream. Tokens that share a place pass, none is lost.
    """
    size = (1 << bits_) // 8

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for b in batches:
            at, count = np.unique(b.column("token").to_numpy() & ((1 << bits_) - 1), return_counts=True)
            byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
            again = (count > 1) | ((once[byte] & bit) > 0)
            np.bitwise_or.at(more, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        parts = [[zlib.compress(x.tobytes(), 1) for x in marks.reshape(SLICES, -1)] for marks in (once, more)]
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["slice", "once", "more"])
        released()

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, *blobs in zip(b["slice"], b["once"], b["more"]):
                own, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in blobs)
                once, more = total.get(s) or (np.zeros(len(own), np.uint8), np.zeros(len(own), np.uint8))
                total[s] = once | own, more | twice | (once & own)
        if total:
            yield pd.DataFrame({"slice": list(total), "bits": [more.tobytes() for _, more in total.values()]})
        released()

    with shuffles_go(listed.sparkSession):
        marks = listed.select("token").mapInArrow(marked, "slice int, once binary, more binary")
        found = marks.repartition(SLICES, "slice").mapInPandas(added, "slice int, bits binary").collect()
    out, own = np.zeros(size, np.uint8), size // SLICES
    for r in found:
        out[r["slice"] * own : (r["slice"] + 1) * own] = np.frombuffer(r["bits"], np.uint8)
    return out


def bands(n, num: int, den: int):
    """The size band of a native column; sizes within the ratio lie in one band or in neighbouring ones."""
    if num == den:
        return n.cast("long")
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(den / num) * (1 + 1e-9))))


def met(tokens: np.ndarray, nids: np.ndarray, sizes: np.ndarray, early: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hub, nid, n) of whole groups of rows sorted by token: per token and run of sizes, each within the ratio of
    the one before it, the smallest nid is the hub of the others; runs without an early row bring nothing together."""
    order = np.lexsort((sizes, tokens))
    tokens, nids, sizes, early = tokens[order], nids[order], sizes[order].astype(np.int64), early[order]
    start = np.r_[True, (tokens[1:] != tokens[:-1]) | (num * sizes[1:] > den * sizes[:-1])]
    run = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    low, high = np.minimum.reduceat(nids, first), np.maximum.reduceat(nids, first)
    ok = ((low < high) & np.logical_or.reduceat(early, first))[run]
    return low[run][ok], nids[ok], sizes[ok]


def hubs(rows: DataFrame, num: int, den: int, several) -> DataFrame:
    """(hub, nid, n) with hub < nid, and (hub, hub, n): all sets that may link share a hub.

    several: the filter of repeated(). Rows whose token it has not stay where they are.
    """

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_has(several.value, b.column("token").to_numpy())))
        released()

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hub", pa.int64()), ("nid", pa.int64()), ("n", pa.int64())])
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool)]
        for b in batches:
            packed = b.column("set").to_numpy(zero_copy_only=False).view(np.uint64)
            fields = (packed >> np.uint64(24)).view(np.int64), (packed >> np.uint64(1) & np.uint64(MOST)).view(np.int64), (packed & np.uint64(1)).astype(bool)
            got = [b.column("token").to_numpy(zero_copy_only=False), *fields]
            held = [np.concatenate(x) for x in zip(held, got)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # its group may go on
            if last:
                out = met(*(x[:last] for x in held), num, den)
                held = [x[last:] for x in held]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=schema)
        if len(held[0]) and len((out := met(*held, num, den))[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=schema)
        released()

    few = rows.filter("not hot").select("token", "set").mapInArrow(passed, "token long, set long").repartition("token").sortWithinPartitions("token")
    few = few.mapInArrow(cold, "hub long, nid long, n long")
    packed = F.col("set")
    fields = F.shiftrightunsigned(packed, 24).alias("nid"), F.shiftright(packed, 1).bitwiseAND(MOST).alias("n"), (packed.bitwiseAND(1) == 1).alias("early")
    many = rows.filter("hot").select("token", *fields)
    shared = many.groupBy("token").agg(F.min("nid").alias("a"), F.max("nid").alias("z"), F.max("early").alias("any")).filter("a < z and any").select("token")
    many = many.join(shared, "token")
    band = bands(F.col("n"), num, den)
    many = many.withColumn("band", F.explode(F.array(band, band + 1)))
    groups = many.groupBy("token", "band").agg(F.min("nid").alias("hub"), F.max("nid").alias("z"), F.max("early").alias("any")).filter("hub < z and any").select("token", "band", "hub")
    # the hub's own row is among those that it meets
    return few.unionByName(many.join(groups, ["token", "band"]).select("hub", "nid", "n")).distinct()


def likely(members: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """members (hub, nid, n) without those that cannot link with any other set under their hub."""
    load = members.groupBy("hub").agg(F.count("*").alias("c"), F.sum("n").alias("grams"))
    members = members.join(load, "hub")
    small = (F.col("c") <= FILTER_SETS) & (F.col("grams") <= FILTER_GRAMS)
    maps = rows.filter("n > 0").groupBy("fp").agg(F.max("bits").alias("bits"), F.max("n").alias("n")).select(_node("fp").alias("nid"), "n", "bits")

    def kept(g: dict) -> list[tuple]:
        hub = g["hub"][0]
        ok = partners(np.array(g["n"], np.int64), g["bits"], g["nid"].index(hub), num, den)
        if not ok.any():
            return []
        ok |= np.array(g["nid"]) == hub  # the hub leads its blocks, linked or not
        return [(hub, nid, n) for nid, n, k in zip(g["nid"], g["n"], ok) if k]

    found = streamed(members.filter(small).select("hub", "nid").join(maps, "nid").select("hub", "nid", "n", "bits"), ("hub",), kept, "hub long, nid long, n long")
    return found.unionByName(members.filter(~small).select("hub", "nid", "n")).distinct()


def bitmap(ids: DataFrame, bits_: int = FILTER_BITS) -> np.ndarray:
    """A filter of 2^bits_ positions, packed, over ids(nid): bit nid mod 2^bits_."""
    part = (1 << bits_) // SLICES

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b["nid"].to_numpy(np.int64) & ((1 << bits_) - 1)
            for s in np.unique(at // part):
                held.setdefault(int(s), np.zeros(part, bool))[at[at // part == s] % part] = True
        if held:
            yield pd.DataFrame({"slice": list(held), "bits": [np.packbits(x).tobytes() for x in held.values()]})
        released()

    slice_of = F.floor(F.col("nid").bitwiseAND((1 << bits_) - 1) / part)
    with shuffles_go(ids.sparkSession):
        found = ids.select("nid").repartition(SLICES, slice_of).mapInPandas(bits, "slice int, bits binary").collect()
    out = np.zeros((1 << bits_) // 8, np.uint8)
    for r in found:
        out[r["slice"] * part // 8 : (r["slice"] + 1) * part // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def leaders(rows: DataFrame) -> DataFrame:
    """(nid): of every set of rows(doc_id, n, fp) the smallest id. Rows without an id always lead."""
    return rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("nid")).filter("nid is not null").select("nid")


def gathered(docs: DataFrame, k: int, wanted, leading) -> DataFrame:
    """(nid, fp, grams) of the sets that the filter passes, each once: a task sends on one of its copies of a set, if any leads it."""
    schema = pa.schema([("nid", pa.int64()), ("fp", pa.binary()), ("grams", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        most, seen = len(bits) * 8 - 1, set()
        for b in batches:
            nids, fps, grams, held = [], [], [], 0
            for text in _texts(b, leading.value):
                g = gram_set(text, k)
                fp = fingerprint(g)
                nid = node_id(fp)
                at = nid & most
                if not len(g) or not bits[at >> 3] >> (7 - (at & 7)) & 1 or fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                nids.append(nid)
                fps.append(fp)
                grams.append(g.tobytes())
                held += len(g)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((nids, fps, grams), schema)], schema=schema)
                    nids, fps, grams, held = [], [], [], 0
            if nids:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((nids, fps, grams), schema)], schema=schema)
        released()

    # dealt by nid, as the join with the members needs them
    return docs.select("doc_id", "text").mapInArrow(made, "nid long, fp binary, grams binary").repartition("nid").dropDuplicates(["nid", "fp"])


class Trie:
    """A compressed trie of sets, with the classes of those already connected."""

    def __init__(self, sets: list[np.ndarray], level: np.ndarray, num: int, den: int):
        """sets: sorted hash arrays. They are renamed to ranks in the global order, frequent first."""
        self.num, self.den = num, den
        every = np.unique(np.concatenate(sets))
        rank = np.empty(len(every), np.int32)
        rank[np.lexsort((every, -level[bucket(every, len(level))].astype(np.int16)))] = np.arange(len(every), dtype=np.int32)
        ranked = [np.sort(rank[np.searchsorted(every, s)]) for s in sets]
        keys = [r.astype(">i4").tobytes() for r in ranked]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.place = {s: i for i, s in enumerate(self.order)}
        self.sets = [ranked[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        self.mark = np.zeros(len(every), bool)
        self.label = np.arange(len(sets))
        self._build()

    def _build(self) -> None:
        """nodes: (path start, path end, first leaf, past the last leaf, children); a node's path is a slice of its first leaf."""
        n = len(self.sets)
        common = [0] * (n + 1)  # of leaf i with leaf i - 1
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[i] = int(differ[0]) if len(differ) else m
        self.nodes: list[list] = []

        def new(start: int, end: int, lo: int) -> int:
            self.nodes.append([start, end, lo, 0, [], 0, 0])
            return len(self.nodes) - 1

        root = new(0, 0, 0)
        path, leaves = [root], set()
        for i in range(n):
            depth = common[i]
            last = None
            # up to the node that leaf i branches from; a leaf that ends there becomes a child of that node
            while self.nodes[path[-1]][1] > depth or (path[-1] in leaves and self.nodes[path[-1]][1] == depth):
                last = path.pop()
                self.nodes[last][3] = i
            top = path[-1]
            if last is not None and self.nodes[top][1] < depth:
                # the last path is split where leaf i leaves it
                mid = new(self.nodes[last][0], depth, self.nodes[last][2])
                self.nodes[last][0] = depth
                self.nodes[mid][4].append(last)
                self.nodes[top][4][-1] = mid
                path.append(mid)
                top = mid
            leaf = new(self.nodes[top][1], len(self.sets[i]), i)
            self.nodes[top][4].append(leaf)
            leaves.add(leaf)
            path.append(leaf)
        while path:
            self.nodes[path.pop()][3] = n
        for x in self.nodes:
            sizes = self.size[x[2] : x[3]]
            x[5], x[6] = int(sizes.min()), int(sizes.max())

    def walk(self, x: np.ndarray, own: int | None) -> list[int]:
        """Leaves that link with the set x (ranks, ascending); own: the class whose sets are passed over."""
        num, den, total = self.num, self.den, self.num + self.den
        n = len(x)
        self.mark[x] = True
        out, todo = [], [(0, 0)]
        while todo:
            at, overlap = todo.pop()
            start, end, lo, hi, children, least, most = self.nodes[at]
            # sizes must lie within the ratio
            if den * most < num * n or num * least > den * n:
                continue
            if own is not None and (self.label[lo:hi] == own).all():
                continue
            left = n
            if end > start:
                path = self.sets[lo][start:end]
                overlap += int(np.count_nonzero(self.mark[path]))
                left = n - int(np.searchsorted(x, path[-1], "right"))
            bound = overlap + min(most - end, left)
            if total * bound < num * (n + least):
                continue
            if not children:
                if total * overlap >= num * (n + most):
                    out.append(lo)
                    # one link connects with the leaf's whole class
                    if own is not None:
                        self.label[self.label == self.label[lo]] = own
                continue
            todo += [(c, overlap) for c in reversed(children)]
        self.mark[x] = False
        return out

    def forest(self, first: int) -> list[tuple[int, int]]:
        """Links (set, set) that connect all linked sets; set `first` walks first."""
        out = []
        for s in [first, *(i for i in range(len(self.sets)) if i != first)]:
            i = self.place[s]
            out += [(s, self.order[j]) for j in self.walk(self.sets[i], int(self.label[i])) if j != i]
        return out

    def connected(self, a: int, b: int) -> bool:
        return self.label[self.place[a]] == self.label[self.place[b]]


def split(full: DataFrame, rest: DataFrame, skips: DataFrame, shared: int, num: int, den: int, order) -> tuple[DataFrame, DataFrame]:
    """(members, skips) of smaller groups for the sets of groups that have unconnected ones.

    Linked sets share `shared` n-grams among the rarest |x| - ceil(t |x|) + shared of each. `shared` - 1 are set
    aside: those of the group's skips(gid, skip), and in the first round the one that most of the group has. Sets
    meet under each of the others, if an unconnected set has it; sets too small for that meet under -1.
    """
    unconnected = rest.select("gid", "nid").distinct().withColumn("loose", F.lit(1))
    own = full.filter("blocks > 1").select("gid", "nid", "n", "grams").dropDuplicates(["gid", "nid"])
    own = own.join(unconnected.select("gid").distinct(), "gid", "left_semi").join(unconnected, ["gid", "nid"], "left")
    schema = pa.schema([(c, pa.int64()) for c in ("gid", "token", "nid", "n", "loose")])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        for b in batches:
            for gid, nid, n, data, loose in zip(*(b.column(c).to_pylist() for c in ("gid", "nid", "n", "grams", "loose"))):
                grams = np.frombuffer(data, np.uint64)
                need = -(-num * len(grams) // den)
                at = np.lexsort((grams, level[bucket(grams, len(level))]))[: len(grams) - need + shared]
                found = grams[at].view(np.int64) if need >= shared else np.array([-1])
                yield pa.RecordBatch.from_arrays([pa.array(found) if c == "token" else pa.array(np.full(len(found), v, np.int64)) for c, v in (("gid", gid), ("token", 0), ("nid", nid), ("n", n), ("loose", loose or 0))], schema=schema)

    rows = cut(own.mapInArrow(tokens, "gid long, token long, nid long, n long, loose long"), "split")
    # what all tasks agree on before sets meet: counts, partially aggregated
    counts = cut(rows.groupBy("gid", "token").agg(F.count("*").alias("c"), F.min("nid").alias("lead"), F.max("loose").alias("any")).filter("c > 1"), "split-counts")
    counts = counts.join(skips, "gid", "left").withColumn("skip", F.coalesce("skip", F.array().cast("array<long>")))
    if shared == 2:
        common = counts.filter("token != -1").groupBy("gid").agg(F.max_by("token", F.struct("c", "token")).alias("common"))
        counts = counts.join(common, "gid", "left").withColumn("skip", F.when(F.col("common").isNull(), F.col("skip")).otherwise(F.array("common"))).drop("common")
    groups = counts.filter((F.col("any") == 1) & ~F.array_contains("skip", F.col("token")))
    groups = cut(groups.select("gid", "token", "lead", F.xxhash64("gid", "token").alias("next"), F.array_append("skip", F.col("token")).alias("skip")), "split-groups")
    members = rows.join(groups.select("gid", "token", "lead", "next"), ["gid", "token"]).select(F.col("next").alias("gid"), "lead", "nid", "n")
    return members, groups.select(F.col("next").alias("gid"), "skip")


def links(members: DataFrame, sets: DataFrame, num: int, den: int, order) -> DataFrame:
    """(a, b): fingerprints of linked sets, at least a spanning forest of every component."""

    def grown(g: dict) -> list[tuple]:
        """Rows: (a, b) of links; in a group of several blocks also (gid, block, nid) of sets not connected with its lead."""
        fps, nids = g["fp"], g["nid"]
        gid, at, many = g["gid"][0], g["block"][0], g["blocks"][0] > 1
        trie = Trie([np.frombuffer(x, np.uint64) for x in g["grams"]], order.value, num, den)
        first = nids.index(g["lead"][0])
        rows = [(fps[i], fps[j], None, None, None) for i, j in trie.forest(first)]
        if many:
            rows += [(None, None, gid, at, nids[i]) for i in range(len(nids)) if not trie.connected(first, i)]
        return rows

    def walked(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members with their blocks and sets, rows of grown()); the lead is in every block of its group."""
        blocks = members.groupBy("gid").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
        members = members.join(blocks, "gid")
        block = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
        block = F.when(F.col("lead") == F.col("nid"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
        full = cut(members.withColumn("block", F.explode(block)).select("gid", "lead", "block", "blocks", "nid", "n").join(sets, "nid"), "members")
        found = streamed(full.select("gid", "lead", "block", "blocks", "nid", "fp", "grams"), ("gid", "block"), grown, "a binary, b binary, gid long, block long, nid long")
        return full, cut(found, "links")

    out, skips = None, members.sparkSession.createDataFrame([], "gid long, skip array<long>")
    now = members.select(F.col("hub").alias("gid"), F.col("hub").alias("lead"), "nid", "n")
    for shared in range(2, SPLITS + 3):
        full, found = walked(now)
        linked = found.filter("a is not null").select("a", "b")
        out = linked if out is None else out.unionByName(linked)
        rest = found.filter("nid is not null").select("gid", F.col("block").alias("from_block"), "nid")
        if not rest.limit(1).count():
            return out
        if shared < SPLITS + 2:
            now, skips = split(full, rest, skips, shared, num, den, order)

    def crossed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Walks of a block's unconnected sets through another block."""
        rows = []
        if len(left) and len(right):
            all_sets = [np.frombuffer(g, np.uint64) for g in [*right["grams"], *left["grams"]]]
            trie = Trie(all_sets, order.value, num, den)
            fps = [*right["fp"], *left["fp"]]
            for s in range(len(right), len(fps)):
                i = trie.place[s]
                rows += [(fps[s], fps[trie.order[j]]) for j in trie.walk(trie.sets[i], int(trie.label[i])) if j != i]
        return pd.DataFrame(rows, columns=["a", "b"])

    # only groups of several blocks have sets left to walk, and blocks to walk through
    several = full.filter("blocks > 1")
    walking = rest.join(several.select("gid", F.col("block").alias("from_block"), "blocks", "nid", "fp", "grams"), ["gid", "from_block", "nid"])
    walking = walking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block != from_block")
    there = rest.select("gid", "from_block").distinct().join(several.select("gid", "block", "fp", "grams"), "gid").filter("block != from_block")
    there = there.select(*(F.col(c).alias(c) for c in there.columns))  # columns of its own: both sides come from one table
    keys = ("gid", "from_block", "block")
    return out.unionByName(walking.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(crossed, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of edges(a, b) the smallest node that it reaches.

    Alternating star steps until nothing changes, each step written to the shared folder; in each, a node's edges
    move to the smallest neighbour (the larger neighbours' first, then the smaller ones').
    """
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if not n or state == (n, total):
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state = (n, total)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u != v").distinct(), "edges")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text); sets link at Jaccard similarity num / den.

    component_id is the smallest doc_id reachable by links. A text that is null or without words has an empty set
    and links with nothing: its component is its own doc_id. Repeated texts are copies and link; rows that repeat
    a doc_id are separate rows. A null doc_id takes part but is never the smallest unless all are null. An empty
    table gives an empty result. Other columns of docs are not read.
    """
    return classes(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, fp, key, component_id of every row: join() with the fingerprint of the row's set and of its component.

    Rows are of one component if their keys are equal; an empty set has none. Other than component_id, the key also
    tells components apart that share their smallest doc_id.
    """
    sc = docs.sparkSession.sparkContext
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.count()
    size = 1 << bits_for(total, SKETCH_BITS, SKETCH_MOST, 32)
    rows, parts = fingerprints(docs, k, size)
    order = sc.broadcast(frequencies(parts, size))
    rows = cut(rows, "rows")
    discard(parts)  # with the table of both
    leading = sc.broadcast(bitmap(leaders(rows), bits_for(total, FILTER_BITS, FILTER_MOST, 8)))
    listed = cut(prefixes(docs, k, num, den, order, leading), "prefixes")
    several = sc.broadcast(repeated(listed, bits_for(listed.count(), TOKEN_BITS, TOKEN_MOST, 8)))
    members = cut(hubs(listed, num, den, several), "met")
    discard(listed)
    several.destroy()
    members = cut(likely(members, rows, num, den), "hubs")
    wanted = sc.broadcast(bitmap(members, bits_for(total, FILTER_BITS, FILTER_MOST, 8)))
    edges = links(members, gathered(docs, k, wanted, leading), num, den, order)
    roots = cut(components(edges), "components")
    return labelled(rows.drop("bits"), roots, total)


def labelled(rows: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """doc_id, n, fp, key, component_id of rows(doc_id, n, fp); roots(node, root) of the linked sets that are no roots.

    Ids are reduced per set, then per root. Sets of one row that link with none are settled by themselves. Of the
    others, the at most HOT_GROUPS sets that more than total / HOT_GROUPS rows share meet their rows by a broadcast;
    the rest meet them by a join whose keys are all small. Empty sets take no part.
    """
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    per = rows.filter("n > 0").groupBy("fp").agg(F.count("*").alias("c"), F.min("doc_id").alias("least"))
    per = cut(per.join(roots, F.col("fp") == F.col("node"), "left").filter("c > 1 or root is not null").select("fp", "c", "least", "root"), "sets")
    least = per.filter("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    own = per.filter("root is null").select("fp", "c", F.col("least").alias("component"), F.col("fp").alias("key"))
    table = cut(own.unionByName(per.join(least, "root").select("fp", "c", "component", F.col("root").alias("key"))), "labels").withColumnRenamed("fp", "set")
    hot = table.filter(F.col("c") > total / HOT_GROUPS).select("set", "component", "key")
    cold = table.filter(F.col("c") <= total / HOT_GROUPS).select("set", "component", "key")
    met = rows.join(F.broadcast(hot), F.col("fp") == F.col("set"), "left").withColumn("done", F.col("set").isNotNull()).drop("set")
    component = F.when(F.col("done"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    settled = met.filter("done or n = 0").select("doc_id", "n", "fp", "key", component)
    others = met.filter("not done and n > 0").drop("component", "key", "done").join(cold, F.col("fp") == F.col("set"), "left")
    others = others.withColumn("done", F.col("set").isNotNull()).select("doc_id", "n", "fp", F.coalesce("key", "fp").alias("key"), component)
    return settled.unionByName(others)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, of each component of join() one row only: that of the smallest doc_id, null ids last.

    Where a component has several rows of that id, the smallest fingerprint, then the smallest text decides. So rows
    that share an id, or have none, stay if no other row is like them. Texts without words stay.
    """
    found = cut(classes(docs, k, num, den), "joined")
    per = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("first"))
    per = cut(per.select("doc_id", "c", (F.coalesce("first", F.lit(0)) == 1).alias("first")), "judged")
    special = cut(per.filter("c > 1 or not first"), "special")
    staying = per.filter("c > 1 or first")

    def among(ids: DataFrame):
        """A function of a column that says which ids may be among these; the others are not."""
        size = bits_for(ids.count(), FILTER_BITS, FILTER_MOST, 8)
        bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.col("doc_id").alias("nid")), size))

        @F.pandas_udf("boolean")
        def may(ids: pd.Series) -> pd.Series:
            at = ids.to_numpy(np.int64) & ((1 << size) - 1)
            return pd.Series((bits.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

        return may

    @F.pandas_udf("binary")
    def named(texts: pd.Series) -> pd.Series:
        out = pd.Series([fingerprint(gram_set(t, k)) for t in texts], dtype=object)
        released()
        return out

    # most rows are settled by two filters where they are, those that stay and those that go alike, so that their texts
    # are not shuffled; only rows that the filters cannot tell meet the list by a join
    ids = F.col("doc_id").cast("long")
    known = F.coalesce(ids, F.lit(-1))  # without nulls, which would make the ids floats
    listed, stays = among(special)(known), among(staying)(known)
    plain = docs.filter(ids.isNotNull() & ~listed)
    rest = docs.filter(ids.isNotNull() & listed & stays).join(special.select("doc_id", F.col("c").alias("__c")), "doc_id", "left")
    single = rest.filter("__c is null").select(*docs.columns)
    # rows that their id does not tell apart: the first row of each set and id, of those the first set of each component
    several = rest.filter("__c > 1").select(*docs.columns).unionByName(docs.filter(ids.isNull())).withColumn("__fp", named("text"))
    empty = several.filter(F.col("__fp") == F.lit(fingerprint(gram_set(None, k)))).select(*docs.columns)
    once = several.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__fp").orderBy("text"))).filter("__n = 1")
    repeated = special.filter("c > 1").select(F.col("doc_id").alias("__id"))
    first = found.filter("n > 0 and component_id <=> doc_id")
    first = first.filter("doc_id is null").unionByName(first.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi"))
    first = first.groupBy("key", F.col("doc_id").alias("__id")).agg(F.min("fp").alias("__set")).select("__id", "__set")
    once = once.join(first, (F.col("__fp") == F.col("__set")) & ids.eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)
    return plain.unionByName(single).unionByName(empty).unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90, 100)
