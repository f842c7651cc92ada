"""Byte-level BPE by longest matches with backtracking.

An Aho-Corasick automaton over the vocabulary (bytes as Latin-1 characters) finds, in one pass over a piece, the
longest token that starts at each byte. The encoder takes longest matches from the left; a token may follow
another only if plain merging of the two tokens' bytes would leave exactly these two. That test is memoised. Where
no token fits, the encoder shortens or takes back the previous token and marks the position as a dead end, so that
each position is left at most once. The result equals that of applying the merges by rank.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from lexloom.storage import bounded_batches

from .memory import released

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of each of a worker's two caches (pieces, and pairs of tokens); about 200 bytes an entry.
CACHE = 600_000
#: Characters of text after which a worker hands on the ids it holds.
CHUNK_CHARS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _ranges(prop: str) -> str:
    """The code points of a Unicode property as ranges of a character class."""
    import regex

    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = codes.astype("<u4").tobytes().decode("utf-32-le")  # not by chr(), whose million objects take 100 MB
    out = []
    for m in regex.finditer(rf"\p{{{prop}}}+", every):
        a, b = m[0][0], m[0][-1]
        if a < "\ud800" < b:  # the string has no surrogates, so a run may step over them
            out.append(f"{a}-{chr(0xD7FF)}{chr(0xE000)}-{b}")
        else:
            out.append(f"{a}-{b}")
    return "".join(out)


_SPLIT: list = []


def splitter():
    """findall of the public splitting pattern, written for the re module with explicit classes (several times faster)."""
    if not _SPLIT:
        import re

        letter, number = _ranges("L"), _ranges("N")
        # White_Space; unlike re's own class it lacks the four separators 0x1C to 0x1F
        space = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
        # the alternatives of public_tokenizers.PATTERN; ' ?L+' may come first since no other can begin where it does
        _SPLIT.append(re.compile(
            rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        ).findall)
    return _SPLIT[0]


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Pieces(dict):
    """Ids of pieces as bytes, made where they are missing.

    Two generations: a full young one becomes the old one, and what is asked for again comes back from there, so
    that frequent pieces stay and at most codec.cache are held.
    """

    def __init__(self, codec):
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = _packed(self.codec.encode_bytes(piece.encode("utf-8")))
            if len(piece) > 64:
                return got
        if len(self) >= self.codec.cache // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, cache: int = 0):
        import ahocorasick

        self.cache = cache or CACHE

        self.ranks = read_ranks(path)
        self.tokens: dict[int, bytes] = {r: t for t, r in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.size = {r: len(t) for r, t in self.tokens.items()}
        self.shorter: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = next((self.ranks[p] for n in range(len(token) - 1, 0, -1) if (p := token[:n]) in self.ranks), None)
            if len(token) > 1:
                halves = self._merge(token, rank)
                if len(halves) == 2:
                    self.parts[rank] = halves
                    self.joined[halves] = rank
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def _merge(self, data: bytes, below: int) -> tuple[int, ...]:
        """Plain merging with the ranks under below."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(self.ranks[p] for p in parts)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves them as they are.

        Undoes the merges of the two tokens from the latest to the earliest. A merge across the border would have
        happened if its rank is below that of the merge that last changed a side at the border.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) >= self.cache:
            self.fits.clear()
        parts, joined = self.parts, self.joined
        bound, answer = 1 << 62, True
        while True:
            across = joined.get((left, right))
            # a merge of equal rank to the left comes first, to the right later: the leftmost pair merges first
            if across is not None and across < bound:
                answer = False
                break
            l, r = parts.get(left), parts.get(right)
            if l is None and r is None:
                break
            if r is None or (l is not None and left > right):
                bound, left = left, l[1]
            else:
                bound, right = right + 1, r[0]
        self.fits[key] = answer
        return answer

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        for end, (rank, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend: the last one kept is the longest
        size_of, shorter, known, fits = self.size, self.shorter, self.fits.get, self.compatible
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], None
        while True:
            while token is not None:
                end = at + size_of[token]
                if end not in dead:
                    if last is None:
                        break
                    ok = known((last, token))
                    if ok or (ok is None and fits(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= size_of[token]
                last = out[-1] if out else None

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null as empty."""
        if not text:
            return b""
        return b"".join(map(self.pieces.__getitem__, splitter()(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary, with its caches, from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def tokenize(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] | None = None, cache: int = 0) -> DataFrame:
    """docs (or its columns in keep) with ids (binary, little-endian unsigned 32-bit), n_tokens, and round_trip: whether decoding gives the text back.

    A narrow pass over whole texts; a worker holds a batch, the vocabulary, bounded caches and the ids of about
    CHUNK_CHARS characters of text. A null text has no ids and decodes to no bytes. Repeated rows agree; an empty
    table gives an empty result; columns of docs with the added names are replaced. The vocabulary is a file that
    every executor has at path. cache: entries of the caches of a codec that lives for a task only, where workers
    share their executor's memory with other operators; 0 keeps a worker's codec with CACHE entries.
    """
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip") and (keep is None or c in keep)]
    kept = docs.select(*rest, F.col(text).alias("__text"))
    schema = StructType([*docs.select(*rest).schema.fields, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(path, cache) if cache else codec(path)
        for b in batches:
            column, first, ids, same, held = b.column(len(rest)), 0, [], [], 0
            for i in range(b.num_rows):
                t = column[i].as_py()
                ids.append(c.encode(t))
                same.append(c.decode(ids[-1]) == (t or "").encode())
                held += len(t or "")
                if held > CHUNK_CHARS or i + 1 == b.num_rows:
                    own = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*(x.slice(first, len(ids)) for x in b.columns[:-1]), *own], schema.names)
                    first, ids, same, held = i + 1, [], [], 0
        del c
        released()

    return kept.mapInArrow(coded, schema)


def digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digest of tokenize(), made beside it so that no ids travel.

    Whole texts, one at a time. Null and empty texts have no ids and the digests of no bytes; repeated rows agree, and
    there are no ties; a null doc_id stays null; an empty table gives an empty result; other columns are not read,
    whatever their names.
    """
    path = path or default_path()
    bounded_batches(docs.sparkSession)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            rows = []
            for doc_id, t in zip(b["doc_id"], b[text]):
                ids = c.encode(t)
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.astype({"doc_id": "Int64"})
        released()

    return docs.select(F.col("doc_id").cast("long"), text).mapInPandas(coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
