"""Benchmark decontamination by a positional inverted index of the training texts, stored in segments.

A segment is a row of the index table: the word positions of some documents, as one sorted list per term. Segments are
made where their documents are read, without a shuffle. A search intersects the offset-adjusted lists of a segment in
the task that reads it, from the rarest term of each phrase on. Long texts lie in several segments that overlap.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches, cut

from .memory import released

#: Words of a window; the bytes of text in a segment, about.
WINDOW, SEGMENT_BYTES = 10, 4 << 20
#: Words of test texts that are searched at once, about: they are broadcast, so more go in further passes.
PASS_WORDS, PIECE_BYTES = 1 << 18, 1 << 18
#: Candidate places that are looked at together.
CANDIDATES = 1 << 20
#: Sets of test texts that at least this part of the documents holds are broadcast with their digest.
HOT_PART = 1024
# What separates words once A-Z are a-z, as a pattern and as bytes of UTF-8.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def pieces(text: str | None, size: int, overlap: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the first word, words of its own, words) of each piece of a text, of about size bytes.

    A piece ends with up to `overlap` words of the next, so that every run of overlap + 1 words lies in one piece. A
    text without words is one empty piece.
    """
    data = (text or "").encode("utf-8", "replace").translate(_PLAIN)
    at, first, own = 0, 0, []
    while True:
        end = data.find(b" ", at + size) if len(data) - at > size else -1
        following = data[at : end if end >= 0 else len(data)].split()
        if own and (len(following) >= overlap or end < 0):
            yield first, len(own), own + following[:overlap]
            first, own = first + len(own), following
        else:
            own = own + following
        if end < 0:
            if own or not first:
                yield first, len(own), own
            return
        at = end


def normal(text: Column) -> Column:
    """The words of a text, joined by blanks; empty for null."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS, " "))


# ---- the index ---------------------------------------------------------------------------------------------------


@dataclass
class Segment:
    """places[ends[t - 1]:ends[t]] are the places of terms[t], sorted. Texts of `lengths` words lie `gap` places apart."""

    terms: list[bytes]
    ends: np.ndarray
    places: np.ndarray
    lengths: np.ndarray
    gap: int

    @classmethod
    def build(cls, texts: list[list[bytes]], gap: int) -> Segment:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
        place = np.arange(len(codes)) + np.repeat(np.arange(len(texts)) * gap, lengths)
        ends = np.bincount(codes, minlength=len(number)).cumsum()
        return cls(list(number), ends, place[np.argsort(codes, kind="stable")], lengths, gap)

    @cached_property
    def starts(self) -> np.ndarray:
        """The place of the first word of each text."""
        return np.concatenate([[0], self.lengths.cumsum()[:-1]]).astype(np.int64) + np.arange(len(self.lengths)) * self.gap

    @cached_property
    def size(self) -> int:
        return int(self.lengths.sum()) + self.gap * (len(self.lengths) + 1)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def steps(self) -> tuple[bytes, bytes]:
        """Places as steps from one to the next of a term, in 16 bits, and the steps that are larger, marked there."""
        step = np.diff(self.places, prepend=0)
        first = self.ends[:-1]
        step[first] = self.places[first]
        large = step >= 0xFFFF
        return np.where(large, 0xFFFF, step).astype("<u2").tobytes(), step[large].astype("<i8").tobytes()

    @classmethod
    def stored(cls, terms: bytes, ends: np.ndarray, steps: bytes, large: bytes, lengths: np.ndarray, gap: int) -> Segment:
        step = np.frombuffer(steps, "<u2").astype(np.int64)
        step[step == 0xFFFF] = np.frombuffer(large, "<i8")
        total = step.cumsum()
        ends = ends.astype(np.int64)
        before = np.concatenate([[0], total])[np.concatenate([[0], ends])[:-1]]
        return cls(terms.split(), ends, total - np.repeat(before, np.diff(ends, prepend=0)), lengths, gap)


_TEXT = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("own", pa.int32()), ("held", pa.int32())])
_SEGMENT = pa.schema([("segment", pa.int64()), ("texts", pa.list_(_TEXT)), ("terms", pa.binary()), ("ends", pa.list_(pa.int32())), ("steps", pa.binary()), ("large", pa.binary())])
SEGMENTS = "segment long, texts array<struct<row:long,doc_id:long,first:long,own:int,held:int>>, terms binary, ends array<int>, steps binary, large binary"


def build(docs: DataFrame, reach: int = WINDOW, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of docs(doc_id, text): a row per segment, see SEGMENTS. Matches up to `reach` words long are found in it.

    Every row of docs is a document; null and empty texts have no words. A segment ends where segment_bytes are
    reached; a longer text is in pieces.
    """
    bounded_batches(docs.sparkSession)

    def stored(held: list, number: int) -> pa.RecordBatch:
        segment = Segment.build([words for *_, words in held], reach)
        texts = [{"row": row, "doc_id": doc, "first": first, "own": own, "held": len(words)} for row, doc, first, own, words in held]
        values = [TaskContext.get().partitionId() << 32 | number, texts, b" ".join(segment.terms), segment.ends, *segment.steps()]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _SEGMENT)], schema=_SEGMENT)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, number, size, held = TaskContext.get().partitionId() << 40, 0, 0, []
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for first, own, words in pieces(text.as_py(), segment_bytes, reach - 1):
                    held.append((row, doc, first, own, words))
                    size += 8 + sum(map(len, words)) + len(words)
                    if size >= segment_bytes:
                        yield stored(held, number)
                        number, size, held = number + 1, 0, []
                row += 1
        if held:
            yield stored(held, number)
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(segments, SEGMENTS)


def opened(b: pa.RecordBatch, reach: int) -> Iterator[tuple[dict[str, np.ndarray], pa.Array, Segment]]:
    """(columns of the texts, their doc_ids, lists) of each segment in a batch of index rows."""
    for i in range(len(b)):
        texts = b.column("texts")[i].values
        about = {c: texts.field(c).to_numpy(zero_copy_only=False) for c in ("row", "first", "own", "held")}
        ends = b.column("ends")[i].values.to_numpy()
        binary = [b.column(c)[i].as_py() for c in ("steps", "large")]
        yield about, texts.field("doc_id"), Segment.stored(b.column("terms")[i].as_py(), ends, *binary, about["held"].astype(np.int64), reach)


# ---- test texts --------------------------------------------------------------------------------------------------


@dataclass
class Windows:
    """Distinct windows of test texts: term numbers by row, -1 behind shorter ones, and the texts that hold each."""

    vocabulary: dict[bytes, int]
    table: np.ndarray
    texts: np.ndarray
    text_ends: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[int, bool, list[bytes]]], window: int) -> Windows:
        """Of pieces (text, whether it is the whole text, words); a whole text of fewer words is one window."""
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        tables, owners = [np.empty((0, window), np.int64)], [np.empty(0, np.int64)]
        for text, whole, words in found:
            codes = np.array([number[w] for w in words], np.int64)
            if len(codes) >= window:
                tables.append(np.lib.stride_tricks.sliding_window_view(codes, window))
            elif whole and len(codes):
                tables.append(np.pad(codes, (0, window - len(codes)), constant_values=-1)[None])
            else:
                continue
            owners.append(np.full(len(tables[-1]), text, np.int64))
        table, at = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([at.reshape(-1), np.concatenate(owners)]), axis=0)
        return cls(dict(number), table, pairs[:, 1], np.bincount(pairs[:, 0], minlength=len(table)).cumsum())

    @cached_property
    def lengths(self) -> np.ndarray:
        return (self.table >= 0).sum(axis=1)

    def owners(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in windows, text) for all texts that hold each of the windows."""
        first, last = np.concatenate([[0], self.text_ends[:-1]])[windows], self.text_ends[windows]
        return spread(first, last - first, self.texts)


def spread(first: np.ndarray, count: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, value) of all slices values[first[i]:first[i] + count[i]]."""
    at = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(at)) - np.repeat(count.cumsum() - count, count)
    return at, values[first[at] + inside]


def _candidates(segment: Segment, own: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of own, place) for the places of each window's rarest term, about CANDIDATES at a time."""
    rare = own[np.arange(len(own)), rank[:, 0]]
    count = segment.counts[rare]
    group = count.cumsum() // CANDIDATES
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        at, place = spread(segment.ends[rare[rows]] - count[rows], count[rows], segment.places)
        yield rows[at], place


def _present(segment: Segment, windows: Windows, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose terms all occur, their term numbers in the segment, and their columns, the rarest first."""
    local = np.full(len(windows.vocabulary) + 1, -1, np.int64)
    for i, t in enumerate(segment.terms):
        if (n := windows.vocabulary.get(t)) is not None:
            local[n] = i
    own = local[table]  # -1, behind short windows, is the last entry
    live = np.flatnonzero(((own >= 0) | (table < 0)).all(axis=1))
    own, inside = own[live], table[live] >= 0
    often = np.where(inside, segment.counts[own] if len(segment.terms) else 0, np.iinfo(np.int64).max)
    return live, own, np.argsort(often, axis=1, kind="stable")


def phrase_matches(segment: Segment, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first place, place behind the last) of all exact occurrences.

    The list of the rarest term, less its offset, is intersected with the next rarer terms' lists in turn; membership
    in those is looked up by place.
    """
    live, own, rank = _present(segment, windows, windows.table)
    term_at = np.full(segment.size + windows.table.shape[1], -1, np.int64)
    term_at[segment.places] = np.repeat(np.arange(len(segment.terms)), segment.counts)
    lengths = windows.lengths[live]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for row, place in _candidates(segment, own, rank):
        start = place - rank[row, 0]
        row, start = row[start >= 0], start[start >= 0]
        for k in range(1, windows.table.shape[1]):
            offset = rank[row, k]
            ok = (k >= lengths[row]) | (term_at[start + offset] == own[row, offset])
            row, start = row[ok], start[ok]
        found.append((row, start))
    row, start = (np.concatenate(x) for x in zip(*found))
    return live[row], start, start + lengths[row]


def near_matches(segment: Segment, windows: Windows, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first place, place behind the last) of spans up to `width` words that hold all words of a window.

    In any order and with others between; a word that repeats in the window is asked once. Of the spans around one
    place of the rarest word the shortest, then first, is returned. The lists are intersected around that word's
    places: a place stays while each list has an entry less than width away.
    """
    repeated = np.array([[t >= 0 and t in row[:i] for i, t in enumerate(row)] for row in windows.table.tolist()], bool).reshape(windows.table.shape)
    table = np.where(repeated, -1, windows.table)
    live, own, rank = _present(segment, windows, table)
    asked = (table[live] >= 0).sum(axis=1)
    keys = np.repeat(np.arange(len(segment.terms)), segment.counts) * segment.size + segment.places
    far = np.int64(1) << 60

    def following(row: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
        """The first place from `place` on of the k-th rarest term of each row."""
        term = own[row, rank[row, k]]
        at = np.searchsorted(keys, term * segment.size + place)
        return np.where(at < segment.ends[term], segment.places[np.minimum(at, len(keys) - 1)], far)

    found = [(np.empty(0, np.int64),) * 3]
    for row, place in _candidates(segment, own, rank):
        for k in range(1, table.shape[1]):
            ok = (k >= asked[row]) | (following(row, np.maximum(place - width + 1, 0), k) < place + width)
            row, place = row[ok], place[ok]
        best, first = np.full(len(row), far), place.copy()
        for back in range(width):
            start, last = place - back, place.copy()
            for k in range(1, table.shape[1]):
                last = np.where(k < asked[row], np.maximum(last, following(row, np.maximum(start, 0), k)), last)
            better = (start >= 0) & (last - start < np.minimum(width, best + 1)) & (last - start <= best)
            best, first = np.where(better, last - start, best), np.where(better, start, first)
        ok = best < width
        found.append((row[ok], first[ok], first[ok] + best[ok] + 1))
    row, first, end = (np.concatenate(x) for x in zip(*found))
    return live[row], first, end


# ---- search ------------------------------------------------------------------------------------------------------

_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("texts", pa.list_(pa.int64()))])
FOUND = "row long, doc_id long, n long, spans array<struct<first:long,end:long>>, texts array<long>"


def _lists(owner: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n lists whose entries, sorted by owner, are given."""
    return np.concatenate([[0], np.bincount(owner, minlength=n).cumsum()]).astype(np.int32)


def _by_text(about: dict[str, np.ndarray], doc_ids: pa.Array, segment: Segment, windows: Windows, matches: tuple, counted: bool) -> pa.RecordBatch:
    """A row per text of the segment: its words, the spans that matches cover, and the test texts that matched."""
    window, start, end = matches
    mark = np.bincount(start, minlength=segment.size + 1) - np.bincount(end, minlength=segment.size + 1)
    edge = np.diff((mark.cumsum() > 0).astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    n, text = len(segment.lengths), lambda place: np.searchsorted(segment.starts, place, "right") - 1
    of = text(first)
    shift = about["first"][of] - segment.starts[of]
    spans = pa.StructArray.from_arrays([pa.array(first + shift), pa.array(last + shift)], fields=list(_FOUND.field("spans").type.value_type))
    met = np.unique(np.column_stack([text(start), window]), axis=0)
    at, owner = windows.owners(met[:, 1])
    pairs = np.unique(np.column_stack([met[at, 0], owner]), axis=0)
    columns = [pa.array(about["row"]), doc_ids, pa.array(about["own"].astype(np.int64) if counted else np.zeros(n, np.int64)), pa.ListArray.from_arrays(_lists(of, n), spans), pa.ListArray.from_arrays(_lists(pairs[:, 0], n), pa.array(pairs[:, 1]))]
    return pa.record_batch(columns, schema=_FOUND)


def tests(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts(number, words), names(number, item_id)) of items(item_id, text): texts of the same words are one text."""
    plain = items.select("item_id", normal(F.col("text")).alias("words")).filter("words != ''")
    texts = cut(plain.select("words").distinct().withColumn("number", F.monotonically_increasing_id()), "tests")
    return texts, plain.join(texts, "words").select("number", "item_id").distinct()


def search(index: DataFrame, texts: DataFrame, window: int = WINDOW, reach: int = WINDOW, width: int | None = None) -> DataFrame:
    """row, doc_id, n, spans, texts per document of the index: its words, the spans of words (first, end) that occurrences
    of windows of texts(number, words) cover, and the numbers of those texts, sorted.

    Exact phrases, or with width the proximity matches within so many words. reach is that of the index; neither the
    window nor width may exceed it. Test texts are broadcast about PASS_WORDS words at a time; a pass reads the index
    once, and no candidate leaves its task.
    """
    if max(window, width or 0) > reach:
        raise ValueError(f"the index finds matches of up to {reach} words")
    spark = index.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(n, own, own == len(words) and not first, b" ".join(words)) for n, text in zip(b.column("number").to_pylist(), b.column("words").to_pylist()) for first, own, words in pieces(text, PIECE_BYTES, window - 1)]
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["number", "n", "whole", "words"])

    parts = cut(texts.select("number", "words").mapInArrow(split, "number long, n long, whole boolean, words binary"), "pieces")
    passes = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // PASS_WORDS))
    out = None
    for p in range(passes):
        own = parts.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == p).collect()
        sent = spark.sparkContext.broadcast(Windows.of([(r["number"], r["whole"], bytes(r["words"]).split()) for r in own], window))

        def met(batches: Iterator[pa.RecordBatch], sent=sent, counted=p == 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for about, doc_ids, segment in opened(b, reach):
                    found = near_matches(segment, sent.value, width) if width else phrase_matches(segment, sent.value)
                    yield _by_text(about, doc_ids, segment, sent.value, found, counted)
            released()

        found = index.mapInArrow(met, FOUND)
        out = found if out is None else out.unionByName(found)
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), lists("spans").alias("spans"), lists("texts").alias("texts"))


def covered(spans: Column) -> Column:
    """The number of words that sorted spans cover, overlaps once."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["words"] + F.greatest(x["end"] - F.greatest(x["first"], s["end"]), F.lit(0))).alias("words"), F.greatest(s["end"], x["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda s: s["words"])


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: a row per row of docs(doc_id, text).

    items(item_id, text) are the test texts. A null or empty text has no words: nothing is found in it or by it. A text
    of fewer words than a window is one window. Rows of docs that repeat, or have no id, are documents of their own;
    rows of items that share an id are one item; those without an id are found (their words are hit), but have no
    name to be listed. Long texts are indexed whole, in pieces that overlap. Without items nothing is hit; without
    documents the result is empty. Other columns are not read. The index is written, then searched.
    """
    index = cut(build(docs.select("doc_id", "text"), window, segment_bytes), "segments")
    texts, names = tests(items.select("item_id", "text"))
    found = cut(search(index, texts, window, window).withColumn("key", F.sha2(F.array_join("texts", ",").cast("binary"), 256)), "found")
    # documents with the same test texts share a digest, which is made once
    sets = cut(found.filter(F.size("texts") > 0).groupBy("key").agg(F.count("*").alias("m"), F.first("texts").alias("texts")), "sets")
    named = sets.select("key", "m", F.explode("texts").alias("number")).join(names, "number", "left")
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    digests = cut(named.groupBy("key").agg(F.first("m").alias("m"), ids.alias("ids")).select("key", "m", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")), "digests")
    hot = F.col("m") * HOT_PART >= (digests.agg(F.sum("m")).first()[0] or 0)
    often, rare = F.broadcast(digests.filter(hot).drop("m")), digests.filter(~hot).drop("m")
    clean, dirty = found.filter(F.size("texts") == 0), found.filter(F.size("texts") > 0)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    every = clean.withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", nothing)
    every = every.unionByName(dirty.join(often, "key")).unionByName(dirty.join(often, "key", "left_anti").join(rare, "key"))
    hit = covered(F.col("spans"))
    return every.select("doc_id", F.col("n").alias("n_words"), hit.alias("n_hit"), "n_items", "items_sha256", (hit > 0).alias("contaminated"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).drop("spans")


def oracle() -> str:
    """DuckDB SQL for the rows of query(): every run of words of every document against every window."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
    b AS (SELECT item_id, {words} AS ws FROM benchmark),
    iw AS (SELECT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WINDOW} THEN [ws] ELSE list_transform(range(1, len(ws) - {WINDOW} + 2), lambda i: ws[i:i + {WINDOW - 1}]) END) AS w FROM b),
    w AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w, ' ') AS w, len(w) AS n FROM iw),
    ln AS (SELECT DISTINCT n FROM w),
    dw AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, ln WHERE len(ws) >= n),
    hit AS MATERIALIZED (SELECT DISTINCT r, i, dw.n, item_id FROM (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM dw) dw JOIN w ON dw.w = w.w AND dw.n = w.n),
    hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
    hi AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS digest FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""
