"""Texts as TIFF images, and TIFF images as rows.

``encode_texts`` stores the UTF-8 bytes of a text, padded by zeros to whole rows
of 64, as an 8-bit grey image. ``decode_pages`` walks the image directories of
any TIFF it knows, decodes the strips or tiles of every page (none, PackBits,
LZW or deflate), undoes the predictor and emits one row per page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, trimmed

ROW = 64
ROWS_OF_OUTPUT = 256

# Fixed values of the TIFF 6.0 format: tags, field types and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as (257 - n, byte), others as (n - 1, bytes)."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges)) if len(a) else edges
    lengths = np.diff(np.append(starts, len(a)))
    out, literal = bytearray(), 0

    def literals(end: int) -> None:
        for i in range(literal, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3):
        at, n = int(starts[k]), int(lengths[k])
        literals(at)
        literal = at + n
        while n > 1:
            m = min(n, 128)
            out.extend((257 - m, data[at]))
            n -= m
        if n:
            out.extend((0, data[at]))
    literals(len(data))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += 2 + n
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
    return b"".join(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear."""
    k = np.arange(n)
    return 9 + (k >= 254).astype(np.int64) + (k >= 766) + (k >= 1790)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    codes, stretches, table, free, known = [], [], {}, 258, None
    put, get = codes.append, table.get
    for c in data:
        if known is None:
            known = c
            continue
        longer = get(pair := known << 8 | c)
        if longer is not None:
            known = longer
            continue
        put(known)
        table[pair] = free
        free += 1
        known = c
        if free == 4095:
            put(256)
            stretches.append(free - 257)
            table.clear()
            free = 258
    if known is not None:
        put(known)
    put(257)
    stretches.append(len(codes) - sum(stretches))
    widths = np.concatenate([_widths(n) for n in stretches])
    bits = np.array(codes)[:, None] >> np.arange(11, -1, -1) & 1
    return np.packbits(bits[np.arange(12) >= 12 - widths[:, None]].astype(np.uint8)).tobytes()


_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]
#: A table of 4,096 entries is full after so many codes.
_MOST = 4096 - 258 + 1
_ENDS = np.cumsum(_widths(_MOST))


def unlzw(data: bytes) -> bytes:
    bits = np.concatenate((np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(12, np.uint8)))
    at, total, out = 0, len(bits) - 12, []
    while n := int(np.searchsorted(_ENDS, total - at, "right")):
        ends, widths = _ENDS[:n], _widths(n)
        twelve = bits[(at + ends - widths)[:, None] + np.arange(12)].astype(np.int64) @ (1 << np.arange(11, -1, -1))
        codes = twelve >> 12 - widths
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        if n == _MOST and not len(stops):
            raise ValueError("an LZW table overflows")
        stop = int(stops[0]) if len(stops) else n
        table, last = list(_SINGLE), b""
        for code in codes[:stop].tolist():
            if not last:
                last = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
                last = entry
            out.append(last)
        if stop == n or codes[stop] == 257:
            break
        at += int(ends[stop])
    return b"".join(out)


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1)}[scheme](data)


def decompress(data: bytes, scheme: int) -> bytes:
    known = {NONE: bytes, PACKBITS: unpackbits, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}
    if scheme not in known:
        raise ValueError(f"compression {scheme} is not supported")
    return known[scheme](data)


def write_tiff(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, tile: int = 0, rows_per_strip: int = 64) -> bytes:
    """A little-endian TIFF of 8-bit grey pages, in strips or in square tiles."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            padded = np.pad(page, ((0, -height % tile), (0, -width % tile)))
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            data = compress(np.ascontiguousarray(block).tobytes(), scheme)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        place = [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        if not tile:
            place = [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1])]
        fields += [(SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), *place]
        rows = []
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, at = struct.pack("<I", len(out)), data
                out += at
            rows.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(rows)) + b"".join(rows)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory, in the file's order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields = {}
        for k in range(count := struct.unpack_from(f"{order}H", data, at)[0]):
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{n}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    where = struct.unpack_from(f"{order}I", data, where)[0]
                fields[tag] = struct.unpack_from(form, data, where)
        yield order, fields
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)[0]


def read_page(data: bytes, order: str, fields: dict[int, tuple]) -> np.ndarray:
    """Samples of a page as an array (height, width, samples of a pixel)."""
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, scheme, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if bits not in (8, 16, 32, 64) or not kind or one(PLANAR, 1) != 1:
        raise ValueError("only whole-byte samples that lie together are supported")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    if TILE_OFFSETS in fields:
        tw, th, offsets, sizes = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0), fields[TILE_OFFSETS], fields[TILE_BYTES]
    else:
        tw, th, offsets, sizes = width, min(height, one(ROWS_PER_STRIP, height)), fields[STRIP_OFFSETS], fields[STRIP_BYTES]
    page = np.zeros((height, width, samples), dtype.newbyteorder("="))
    across = -(-width // tw) if tw else 0
    for k, (at, n) in enumerate(zip(offsets, sizes)):
        y, x = k // across * th, k % across * tw
        rows = th if TILE_OFFSETS in fields else min(th, height - y)
        raw = np.frombuffer(decompress(data[at : at + n], scheme), np.uint8, rows * tw * samples * bits // 8)
        if predictor == 3:  # bytes of a row by significance, then differences of bytes
            planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, -1)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, tw, samples)
        else:
            block = raw.view(dtype).reshape(rows, tw, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=page.dtype)
        part = page[y : y + rows, x : x + tw]
        part[...] = block[: part.shape[0], : part.shape[1]]
    return page


def feature_of(image: np.ndarray) -> str:
    """Size, mean, spread and an average hash of 8 by 8 fields of the first sample."""
    grey = image[:, :, 0].astype(np.float64)
    if not grey.size:
        return f"{grey.shape[1]}x{grey.shape[0]}"
    cut = [np.linspace(0, n, 9).astype(int)[:-1] for n in grey.shape]
    sums = np.add.reduceat(np.add.reduceat(grey, cut[0], axis=0), cut[1], axis=1)
    size = np.add.reduceat(np.add.reduceat(np.ones_like(grey), cut[0], axis=0), cut[1], axis=1)
    mean = grey.mean()
    bits = np.packbits((sums / size > mean).ravel()).tobytes().hex()
    return f"{grey.shape[1]}x{grey.shape[0]}:{mean:.4f}:{grey.std():.4f}:{bits}"


def layout_of(digest: int, n_rows: int) -> dict:
    """How an image is stored: by a digest of its payload, so that each scheme,
    with and without the predictor, in strips and in tiles, stores a like share
    of all bytes; equal texts give equal files. PackBits goes without predictor."""
    scheme = (PACKBITS, LZW, DEFLATE)[digest % 3]
    predictor = 2 if digest // 3 % 2 and scheme != PACKBITS else 1
    if digest // 6 % 2:
        return {"scheme": scheme, "predictor": predictor, "tile": 64 if n_rows >= 64 else 16}
    return {"scheme": scheme, "predictor": predictor, "rows_per_strip": 128}


def text_to_tiff(data: bytes) -> bytes:
    data += b"\0" * (-len(data) % ROW or (0 if data else ROW))
    page = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    return write_tiff([page], **layout_of(zlib.crc32(data), len(page)))


def encode_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with a column ``media``: each whole text as a TIFF.

    A null text is stored as an empty one: one row of zeros. Equal texts give
    equal bytes. Each row stands alone, so ties, repeated rows and nulls in
    other columns need nothing; an empty table gives an empty one. An input
    column named ``media`` is replaced.
    """
    df = df.drop(media) if media != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())])
    at = df.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OF_OUTPUT):
                batch = whole.slice(start, ROWS_OF_OUTPUT)
                stored = [text_to_tiff(t.as_py() or b"") for t in batch.column(at).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary())], [*batch.schema.names, media])

    return df.mapInArrow(trimmed(encode), schema)


def decode_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of each TIFF: the columns of ``df`` and page, width,
    height, samples (of a pixel), pixels (the samples as bytes, in rows, in the
    machine's byte order), feature, error.

    Media that are null, no TIFF, cut short or of an unsupported kind give one
    row with page null and the reason in ``error``; pages before the fault are
    kept. Repeated rows and ties each give their own pages; an empty table gives
    an empty one. Input columns named like an output column are replaced.
    """
    added = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples", T.IntegerType())]
    added += [("pixels", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType())]
    df = df.drop(*({n for n, _ in added} - {media}))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    at = df.columns.index(media)
    kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OF_OUTPUT):
                batch = whole.slice(start, ROWS_OF_OUTPUT)
                of, rows = [], []
                for k, data in enumerate(batch.column(at)):
                    for row in pages_of(data.as_py()):
                        of.append(k)
                        rows.append(row)
                columns = list(zip(*rows)) or [[]] * len(kinds)
                batch = batch.take(pa.array(of, pa.int32()))
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(n for n, _ in added)])

    return df.mapInArrow(trimmed(decode), schema)


def pages_of(data: bytes | None) -> Iterator[tuple]:
    try:
        if data is None:
            raise ValueError("no media")
        for k, (order, fields) in enumerate(directories(data)):
            image = read_page(data, order, fields)
            height, width, samples = image.shape
            yield k, width, height, samples, image.tobytes(), feature_of(image), None
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, MemoryError) as e:
        yield None, None, None, None, None, None, str(e) or type(e).__name__


def op3_tiff(spark, sf_dir) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    stored = encode_texts(docs).select("doc_id", "n_bytes", "media")
    pages = decode_pages(stored)
    size = F.octet_length("pixels")
    return pages.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
