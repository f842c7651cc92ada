"""WARC files: writing archives, normalising monolithic gzip streams, and reading by a sidecar offset index.

The writer makes one gzip stream per archive, as simple crawlers do. The normaliser inflates that stream once,
record by record, rewrites every record as a gzip member of its own and writes a sidecar index of offsets. Readers
seek to a member by the index. Files go to a folder that the driver and executors share, through pyarrow's
filesystems (file, hdfs, s3, gs); each is written under a name that no other attempt uses, and only names that a
finished task reports are read, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches, cut, fresh_path

CRLF = b"\r\n"
EPOCH = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 20
#: Bytes of records after which a writer begins the next archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 6


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() and c not in "\r\n" else "%%%02X" % ord(c) for c in value)


def record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to=None) -> bytes:
    """A response record, or with refers_to a revisit record, whose block is the HTTP head alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        f"WARC-Date: {EPOCH}".encode(),
        b"WARC-Payload-Digest: sha1:" + payload_digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _one_line(url).encode("utf-8", "surrogatepass"))
    if revisit:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> dict:
    """Fields of a record as record() writes them: head (dict), page_id, record_type, digest, refers_to, payload."""
    head, _, rest = data.partition(CRLF + CRLF)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    length = next(int(x.split(b":", 1)[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    number = lambda v: int(v[len(b"<urn:page:") : -1]) if v and v != b"<urn:page:>" else None
    return {
        "head": fields, "page_id": number(fields[b"WARC-Record-ID"]), "record_type": fields[b"WARC-Type"].decode(),
        "digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), "refers_to": number(fields.get(b"WARC-Refers-To")),
        "payload": payload, "payload_bytes": length,
    }


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a gzip stream of one or many members, inflated once; holds one record and one chunk."""
    inflate = zlib.decompressobj(31)
    buffer = bytearray()
    need = None

    def ready() -> Iterator[bytes]:
        nonlocal need
        at = 0
        while True:
            if need is None:
                end = buffer.find(CRLF + CRLF, at)
                if end < 0:
                    break
                head = bytes(buffer[at:end]).split(CRLF)
                length = next(int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:"))
                need = end - at + 4 + length + 4
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at : at + need])
            at += need
            need = None
        del buffer[:at]

    for chunk in chunks:
        while chunk:
            buffer += inflate.decompress(chunk, 4 * _BLOCK)
            yield from ready()
            while inflate.unconsumed_tail:
                buffer += inflate.decompress(inflate.unconsumed_tail, 4 * _BLOCK)
                yield from ready()
            chunk = b""
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
    if buffer or need:
        raise ValueError(f"truncated archive: {len(buffer)} bytes are left over")


def _chunks(f) -> Iterator[bytes]:
    while block := f.read(_BLOCK):
        yield block


def normalise(source: str, target: str) -> int:
    """Rewrite the archive at source as one member per record at target, with the index beside it (target + '.idx').

    The index file has a JSON line per record: offset, length, id. Returns the number of records; none is held.
    """
    (fs1, p1), (fs2, p2) = filesystem(source), filesystem(target)
    records, at = 0, 0
    with fs1.open_input_stream(p1, compression=None) as f, fs2.open_output_stream(p2, compression=None) as out, fs2.open_output_stream(p2 + ".idx", compression=None) as idx:
        for data in records_of(_chunks(f)):
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = deflate.compress(data) + deflate.flush()
            rid = next(x for x in data[: data.find(CRLF + CRLF)].split(CRLF) if x.startswith(b"WARC-Record-ID:")).split(b": ", 1)[1].decode()
            out.write(member)
            idx.write(json.dumps({"offset": at, "length": len(member), "id": rid}).encode() + b"\n")
            records += 1
            at += len(member)
    return records


def with_revisits(pages: DataFrame, page: str = "html", least: int = 0) -> DataFrame:
    """pages with payload (binary), payload_digest and refers_to.

    Among rows with equal payloads of at least `least` bytes, that with the smallest page_id has no refers_to and
    the others refer to it. Equal payloads are found by SHA-1 and length: the smallest id per digest is a partial
    aggregate, so a digest that a third of the rows share is reduced before its shuffle; only digests seen twice
    take part in the join, which Spark broadcasts by measured size or splits by skew. Rows that repeat the first
    row's page_id are responses too; a null page_id refers, or is a response where no equal row has an id.
    """
    data = F.coalesce(F.col(page), F.lit("")).cast("binary")
    hashed = pages.withColumn("payload", data).withColumn("__sha", F.sha1(F.col("payload")))
    firsts = (
        pages.select("page_id", F.sha1(data).alias("__sha"), F.octet_length(data).alias("__n")).filter(F.col("__n") >= least)
        .groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    )
    out = hashed.join(firsts, "__sha", "left")
    first, own = F.col("__first"), F.col("page_id")
    return out.withColumn("refers_to", F.when(own.isNull() | (own != first), first)).drop("__sha", "__first")


def write(pages: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """Write with_revisits() rows as monolithic archives below folder; returns the table of their URIs.

    One or more archives per partition, rolled at ARCHIVE_BYTES of records; a writer holds a batch and zlib's state.
    """

    bounded_batches(pages.sparkSession)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        out, names, size = None, [], 0
        for b in batches:
            for page_id, u, payload, refers in zip(b["page_id"], b["url"], b["payload"], b["refers_to"]):
                if out is None:
                    names.append(f"raw-{uuid.uuid4().hex}.warc.gz")
                    out, deflate, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                payload = bytes(payload)
                data = record(_int(page_id), u, payload, digest(payload), _int(refers))
                out.write(deflate.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
        if names:
            yield pd.DataFrame({"archive": [f"{folder}/{n}" for n in names]})

    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    rows = pages.select(F.col("page_id").cast("string"), F.col(url).alias("url"), "payload", F.col("refers_to").cast("string"))
    return cut(rows.mapInPandas(written, "archive string"), "archives")


def _int(v) -> int | None:
    return None if v is None else int(v)


def normalise_all(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive; returns (archive, records), written to the shared folder. Their indexes are beside them."""

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source in b["archive"]:
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                yield pd.DataFrame({"archive": [target], "records": [normalise(source, target)]})

    n = max(1, archives.count())
    spread = archives.repartition(min(n, 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return cut(spread.mapInPandas(done, "archive string, records long"), "normalised")


def index_of(archives: DataFrame) -> DataFrame:
    """(archive, offset, length, id) of all records, by the sidecar beside each archive; spread over the tasks."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                fs, path = filesystem(archive + ".idx")
                held = []
                with fs.open_input_stream(path, compression=None) as f:
                    for line in io.TextIOWrapper(f, "utf-8"):
                        held.append(json.loads(line))
                        if len(held) == 10_000:
                            yield pd.DataFrame(held).assign(archive=archive)
                            held = []
                if held:
                    yield pd.DataFrame(held).assign(archive=archive)

    found = archives.select("archive").mapInPandas(lines, "offset long, length long, id string, archive string")
    # runs of neighbouring records stay together, and a large archive is read by many tasks
    run = F.floor(F.col("offset") / (4 * _BLOCK))
    return found.select("archive", "offset", "length", "id").repartition("archive", run).sortWithinPartitions("archive", "offset")


def read(index: DataFrame) -> DataFrame:
    """Records by index rows: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null in revisits).

    The digest of a response is computed from the payload that was read; that of a revisit is its header's.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if f is not None:
                        f.close()
                    fs, path = filesystem(archive)
                    name, f = archive, fs.open_input_file(path)
                f.seek(offset)
                r = parse(zlib.decompress(f.read(length), 31))
                body = r["payload"] if r["record_type"] == "response" else None
                url = r["head"].get(b"WARC-Target-URI")
                rows.append((
                    r["page_id"], None if url is None else url.decode("utf-8", "surrogatepass"), r["record_type"],
                    r["digest"] if body is None else digest(body), r["payload_bytes"] if body is None else len(body), r["refers_to"], body,
                ))
                held += len(body or b"")
                if held > 16 * _BLOCK:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return index.select("archive", "offset", "length").mapInArrow(parsed, ", ".join(f"{n} {t}" for n, t, _ in _FIELDS))


_FIELDS = (
    ("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload_digest", "string", pa.string()),
    ("payload_bytes", "long", pa.int64()), ("refers_to", "long", pa.int64()), ("payload", "binary", pa.binary()),
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, _, t) in zip(columns, _FIELDS)], [n for n, _, _ in _FIELDS])


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) as archives below folder, normalise them, and read every record back.

    Null html is an empty payload; repeated rows give repeated records; an empty table gives no archive and an
    empty result; other columns are not read, whatever their names. A task holds one record and its deflated copy at a
    time, so the longest page bounds its memory. Files: folder/raw (monolithic), folder/warc (a member per record,
    each with its .idx, by which the records are read).
    """
    folder = folder or fresh_path(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    archives = write(with_revisits(pages, least=least), f"{folder}/raw")
    filesystem(f"{folder}/warc")[0].create_dir(filesystem(f"{folder}/warc")[1], recursive=True)
    return read(index_of(normalise_all(archives, f"{folder}/warc")))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# SHA-1 as hexadecimal digits to base32: DuckDB has no base32, so the oracle spells out 32 groups of 5 bits.
def oracle() -> str:
    bits = "list_aggregate(list_transform(range(1, 41), lambda i: substr(to_base((('0x' || substr(p.h, i::INT, 1))::INT + 16)::INT, 2), 2, 4)), 'string_agg', '')"
    b32 = "list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({value}) + 1, 1)), 'string_agg', '')"
    value = " + ".join(f"substr(b, (5 * k + {j + 1})::INT, 1)::INT * {1 << (4 - j)}" for j in range(5))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
    b AS (SELECT p.page_id, strlen(t)::BIGINT AS payload_bytes, {bits} AS b, f.first FROM p JOIN f ON p.h = f.h)
    SELECT page_id, payload_bytes, {b32.format(value=value)} AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b"""
