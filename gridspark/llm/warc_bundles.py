"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few whole records,
and at its end a skippable frame with the seek table (the seekable format: sizes
and a checksum of every frame). The index maps the identifier of a record to its
bundle, frame and the offset inside that frame, so that one record costs the
reading of one frame. Any Zstandard reader can read a bundle from end to end.

Payloads that occur again are stored once: the record of the smallest identifier
is the response, the others are revisits that refer to it and carry the HTTP
header only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, scratch_path, shuffle_partitions, trimmed
from .lookup import look_up

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

# Fixed values of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "key string, bundle string, frame int, offset long, length long"
DIGESTS = "key string, payload_bytes long, payload_digest string, record_type string, refers_to string"
RECORDS = "key string, url string, payload binary, payload_digest string, record_type string, refers_to string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(key: str | None) -> str:
    return "<urn:x-none:>" if key is None else f"<urn:x-record:{quote(key, safe='')}>"


def _key(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:x-record:") : -1]) if urn and urn.startswith("<urn:x-record:") else None


@dataclass
class Record:
    key: str | None
    url: str | None
    kind: str
    refers_to: str | None
    digest: str
    http_length: int
    payload: bytes  # empty for a revisit


def to_bytes(key: str | None, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record: a response, or with ``refers_to`` a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if url is not None:  # white space and controls cannot stand in a header line
        lines.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(data: bytes, start: int) -> tuple[dict[bytes, bytes], int]:
    """Header fields from ``start`` and where the block after them begins."""
    end = data.index(b"\r\n\r\n", start)
    fields = (line.split(b":", 1) for line in data[start:end].split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in fields}, end + 4


def parse(data: bytes, start: int = 0) -> tuple[Record, int]:
    """The record at ``start`` and where the next one begins."""
    warc, at = _headers(data, start)
    end = at + int(warc[b"content-length"])
    http, body = _headers(data, at)
    if data[start : start + 5] != b"WARC/" or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    text = {k: v.decode() for k, v in warc.items()}
    record = Record(
        _key(text[b"warc-record-id"]),
        text.get(b"warc-target-uri"),
        text[b"warc-type"],
        _key(text.get(b"warc-refers-to")),
        text[b"warc-payload-digest"].removeprefix("sha1:"),
        int(http[b"content-length"]),
        data[body:end],
    )
    return record, end + 4


class BundleWriter:
    """Writes one bundle, which appears under its name whole or not at all."""

    def __init__(self, fs: pafs.FileSystem, path: str, frame_bytes: int, level: int):
        self.fs, self.path, self.frame_bytes = fs, path, frame_bytes
        self.temp = f"{path}.tmp"
        self.sink = fs.open_output_stream(self.temp)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.n_held = self.n = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[str | None, int, int, int]] = []

    def add(self, key: str | None, record: bytes) -> None:
        if self.held and self.n_held + len(record) > self.frame_bytes:
            self._frame()
        self.index.append((key, len(self.frames), self.n_held, len(record)))
        self.held.append(record)
        self.n_held += len(record)

    def _frame(self) -> None:
        data = b"".join(self.held)
        packed = self.pack.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.n += len(packed)
        self.held, self.n_held = [], 0

    def close(self) -> list[tuple[str | None, int, int, int]]:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()
        self.fs.move(self.temp, self.path)
        return self.index


class Bundle:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.source = fs.open_input_file(path)
        size = self.source.size()
        n, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & HAS_CHECKSUMS else 8
        table = self.source.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, whole, *check = struct.unpack_from("<III" if width == 12 else "<II", table, k * width)
            self.frames.append((at, packed, whole, check[0] if check else None))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, whole, check = self.frames[k]
        data = self.unpack.decompress(self.source.read_at(packed, at), max_output_size=whole)
        if len(data) != whole or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def close(self) -> None:
        self.source.close()


def write_bundles(
    df: DataFrame,
    path: str,
    key: str = "page_id",
    payload: str = "html",
    url: str = "url",
    least_revisit: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Writes a record for every row of ``df`` under ``path`` and returns the
    index: key (as text), bundle, frame, offset in the frame, length.

    The payload is the UTF-8 text, empty where it is null. Of rows with one
    payload of ``least_revisit`` bytes or more, those of the smallest key are
    responses and the others revisits of it; a null key comes after all others,
    and where all keys of a payload are null all its rows are responses. Rows that
    repeat key and payload of a response are responses too. A record longer than
    ``frame_bytes`` has a frame of its own. A null URL has no header; white space
    and other characters that a header line cannot hold are percent-encoded. An
    empty table gives no bundles. Other columns are not read.

    Texts are shuffled once at most, and a payload that many rows share is spread
    over all tasks. A task that is run again writes files of new names; the index
    names those of the attempt that Spark took.
    """
    rows = df.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("p"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("p")))
    shared = rows.where(F.octet_length("p") >= least_revisit).groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = look_up(rows, materialise(shared, "payloads"), "digest", "first", "n")
    refers = F.when((F.octet_length("p") >= least_revisit) & ~F.col("k").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = rows.select(F.col("k").cast("string").alias("k"), "u", "p", "digest", refers.alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part, number, writer, attempt = TaskContext.get().partitionId(), 0, None, uuid.uuid4().hex[:12]
        for some in batches:
            for k, u, p, digest, refers in zip(*(c.to_pylist() for c in some.columns)):
                if writer is None:
                    writer = BundleWriter(fs, f"{root}/part-{part:06d}-{number:05d}-{attempt}.warc.zst", frame_bytes, level)
                writer.add(k, to_bytes(k, u, p, digest, refers))
                if writer.n >= bundle_bytes:
                    yield _index_batch(writer)
                    writer, number = None, number + 1
        if writer is not None:
            yield _index_batch(writer)

    return materialise(rows.mapInArrow(trimmed(write), INDEX), "warc-index")


def _index_batch(writer: BundleWriter) -> pa.RecordBatch:
    keys, frames, offsets, lengths = zip(*writer.close())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([writer.path] * len(keys), pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
        ["key", "bundle", "frame", "offset", "length"],
    )


def _digest_rows(records: list[Record]) -> pa.RecordBatch:
    """Of a response what its stored payload has; of a revisit what its headers say of the payload it refers to."""
    whole = [r.kind == "response" for r in records]
    columns = (
        pa.array([r.key for r in records], pa.string()),
        pa.array([len(r.payload) if w else r.http_length for r, w in zip(records, whole)], pa.int64()),
        pa.array([base32(hashlib.sha1(r.payload).digest()) if w else r.digest for r, w in zip(records, whole)], pa.string()),
        pa.array([r.kind for r in records], pa.string()),
        pa.array([r.refers_to for r in records], pa.string()),
    )
    return pa.RecordBatch.from_arrays(list(columns), ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _record_rows(records: list[Record]) -> pa.RecordBatch:
    columns = (
        pa.array([r.key for r in records], pa.string()),
        pa.array([r.url for r in records], pa.string()),
        pa.array([r.payload if r.kind == "response" else None for r in records], pa.binary()),
        pa.array([r.digest for r in records], pa.string()),
        pa.array([r.kind for r in records], pa.string()),
        pa.array([r.refers_to for r in records], pa.string()),
    )
    return pa.RecordBatch.from_arrays(list(columns), ["key", "url", "payload", "payload_digest", "record_type", "refers_to"])


def _read(places: DataFrame, path: str, rows, schema: str) -> DataFrame:
    """``places``: bundle, frame and offset (null: all records of the frame), sorted within partitions."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        name = bundle = number = data = None
        for some in batches:
            for file, frame, offset in zip(*(c.to_pylist() for c in some.columns)):
                if file != name:
                    if bundle is not None:
                        bundle.close()
                    name, bundle, number = file, Bundle(fs, file), None
                if frame != number:
                    number, data = frame, bundle.frame(frame)
                if offset is not None:
                    yield rows([parse(data, offset)[0]])
                    continue
                found, at = [], 0
                while at < len(data):
                    record, at = parse(data, at)
                    found.append(record)
                yield rows(found)
        if bundle is not None:
            bundle.close()

    return places.mapInArrow(trimmed(read), schema)


def _frames(index: DataFrame) -> DataFrame:
    places = index.select("bundle", "frame", F.lit(None).cast("long").alias("offset")).distinct()
    return places.repartitionByRange(shuffle_partitions(index.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame")


def read_bundles(index: DataFrame, path: str) -> DataFrame:
    """All records of the bundles in the index, read frame by frame: key, url,
    payload (null for a revisit), payload_digest, record_type, refers_to."""
    return _read(_frames(index), path, _record_rows, RECORDS)


def read_digests(index: DataFrame, path: str) -> DataFrame:
    """For each record what its payload is, without the payload: payload_bytes and
    payload_digest, worked out from the stored bytes of responses."""
    return _read(_frames(index), path, _digest_rows, DIGESTS)


def fetch(index: DataFrame, path: str, keys: DataFrame) -> DataFrame:
    """The records of some keys (one column), by random access: one frame is read
    for each frame that has one of them. A revisit has the payload of the response
    that it refers to. Keys that are not there, and null, give no rows."""
    wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct()

    def records(of: DataFrame) -> DataFrame:
        places = index.join(of, "key", "left_semi").select("bundle", "frame", "offset")
        places = places.repartitionByRange(shuffle_partitions(index.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
        return _read(places, path, _record_rows, RECORDS)

    found = materialise(records(wanted), "records")
    referred = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("key")).distinct()
    whole = records(referred).where("record_type = 'response'").select(F.col("key").alias("refers_to"), "payload_digest", F.col("payload").alias("stored"))
    out = found.join(whole.dropDuplicates(["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], "left")
    return out.select("key", "url", F.coalesce("payload", "stored").alias("payload"), "payload_digest", "record_type", "refers_to")


def op11_warc_bundles(spark, sf_dir) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    path, kind = scratch_path(spark, "bundles"), dict(pages.dtypes)["page_id"]
    out = read_digests(write_bundles(pages, path), path)
    return out.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
hashed AS (
  SELECT page_id, octet_length(p) AS payload_bytes, sha1(p) AS hex FROM payloads),
named AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
