"""Files of the classic NetCDF formats (CDF-1, CDF-2, CDF-5), by their byte layout.

A file is a header (dimensions, attributes, variables with their places) and the
values: variables without the record dimension one after another, then records,
each with a slice of every record variable. A variable's values, or those of a
range of its records, are read without touching the bytes of others.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
DIMENSION, VARIABLE, ATTRIBUTE = 0x0A, 0x0B, 0x0C
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}
STREAMING = 0xFFFFFFFF

HEADER_BYTES = 1 << 16


class Damaged(ValueError):
    """What is there is no whole file of these formats."""


@dataclass
class Variable:
    name: str
    dims: list[str]
    attrs: dict
    dtype: np.dtype
    begin: int
    shape: tuple[int, ...]
    record: bool

    @property
    def row_bytes(self) -> int:
        """Bytes of one step of the first dimension."""
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize


@dataclass
class Header:
    version: int
    records: int
    dims: dict[str, int]
    attrs: dict
    variables: dict[str, Variable]
    record_bytes: int
    record_dim: str | None = None
    size: int = 0


class _Cursor:
    """Reads a header from the first bytes of a file, and more of them where needed."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data, self.wide = file, size, 0, b"", False

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.size:
            raise Damaged("the header goes beyond the end of the file")
        if self.at + n > len(self.data):
            upto = min(self.size, max(self.at + n, 2 * len(self.data), HEADER_BYTES))
            self.data += self.file.read_at(upto - len(self.data), len(self.data))
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">Q", self.take(8))[0] if self.wide else self.u32()

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def listed(self, tag: int) -> int:
        found, n = self.u32(), self.count()
        if found not in (0, tag) or found == 0 and n:
            raise Damaged("the header has no such list")
        if n > self.size:
            raise Damaged("the header counts more than the file can hold")
        return n

    def kind(self) -> np.dtype:
        code = self.u32()
        if code not in TYPES:
            raise Damaged(f"unknown type {code}")
        return np.dtype(TYPES[code])

    def attributes(self) -> dict:
        found = {}
        for _ in range(self.listed(ATTRIBUTE)):
            name, kind = self.name(), self.kind()
            n = self.count()
            raw = self.padded(n * kind.itemsize)
            if kind.kind == "S":
                found[name] = raw.rstrip(b"\0").decode("utf-8", "replace")
            else:
                values = np.frombuffer(raw, kind)
                found[name] = values[0].item() if n == 1 else values.tolist()
        return found


def read_header(file, size: int) -> Header:
    """``file``: something with ``read_at(n, place)``. Raises Damaged."""
    try:
        return _header(file, size)
    except (UnicodeDecodeError, struct.error, OverflowError) as e:
        raise Damaged(str(e)) from e


def _header(file, size: int) -> Header:
    c = _Cursor(file, size)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise Damaged("no classic NetCDF file")
    c.wide = magic[3] == 5
    records = c.count()
    dims = [(c.name(), c.count()) for _ in range(c.listed(DIMENSION))]
    attrs = c.attributes()
    variables, record_size, n_record = {}, 0, 0
    for _ in range(c.listed(VARIABLE)):
        name = c.name()
        ids = [c.count() for _ in range(c.count())]
        if any(i >= len(dims) for i in ids):
            raise Damaged(f"{name} has a dimension that is not there")
        own, kind = c.attributes(), c.kind()
        c.count()  # the size, which follows from the shape as well
        begin = c.u32() if magic[3] == 1 else struct.unpack(">Q", c.take(8))[0]
        record = bool(ids) and dims[ids[0]][1] == 0
        if any(dims[i][1] == 0 for i in ids[1:]):
            raise Damaged(f"{name} has records within records")
        v = Variable(name, [dims[i][0] for i in ids], own, kind, begin, tuple(dims[i][1] for i in ids), record)
        variables[name] = v
        if record:
            n_record += 1
            record_size += v.row_bytes + -v.row_bytes % 4
    if n_record == 1:  # a single record variable is not padded
        record_size = next(v.row_bytes for v in variables.values() if v.record)
    if records == (STREAMING if not c.wide else (1 << 64) - 1):
        first = min((v.begin for v in variables.values() if v.record), default=size)
        records = (size - first) // record_size if record_size else 0
    for v in variables.values():
        if v.record:
            v.shape = (records, *v.shape[1:])
            end = v.begin + max(0, records - 1) * record_size + (v.row_bytes if records else 0)
        else:
            end = v.begin + int(np.prod(v.shape, dtype=np.int64)) * v.dtype.itemsize
        if end > size:
            raise Damaged(f"the values of {v.name} go beyond the end of the file")
    record_dim = next((n for n, length in dims if length == 0), None)
    return Header(magic[3], records, {n: length or records for n, length in dims}, attrs, variables, record_size, record_dim, size)


def read_values(file, header: Header, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of a variable as they are stored, of steps first to last of its first dimension."""
    v = header.variables[name]
    if not v.shape:
        return np.frombuffer(file.read_at(v.dtype.itemsize, v.begin), v.dtype)[0]
    last = v.shape[0] if last is None else min(last, v.shape[0])
    first, n = min(first, last), v.row_bytes
    if v.record and header.record_bytes != n:
        raw = b"".join(file.read_at(n, v.begin + k * header.record_bytes) for k in range(first, last))
    else:
        raw = file.read_at(n * (last - first), v.begin + first * n)
    if len(raw) < n * (last - first):
        raise Damaged(f"{name} is cut off")
    return np.frombuffer(raw, v.dtype).reshape(last - first, *v.shape[1:])


def decoded(v: Variable, values: np.ndarray) -> np.ndarray:
    """Values as doubles: fill values and NaN are missing (NaN), scaled and offset as the attributes say."""
    out = values.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        for fill in np.atleast_1d(v.attrs.get(name, [])):
            if not isinstance(fill, str):
                out[values == np.asarray(fill).astype(v.dtype)] = np.nan
    scale, offset = v.attrs.get("scale_factor", 1), v.attrs.get("add_offset", 0)
    return out * scale + offset if (scale, offset) != (1, 0) else out


@dataclass
class Written:
    """A variable to write. ``values``: an array whose shape is that of ``dims``."""

    name: str
    dims: Sequence[str]
    values: np.ndarray
    attrs: dict = field(default_factory=dict)


def write_file(sink, variables: Sequence[Written], attrs: dict | None = None, record_dim: str | None = None, version: int | None = None) -> int:
    """Writes a file to ``sink`` (``write(bytes)``) and returns its size. The
    version is 2 unless a type needs 5. ``record_dim`` is the dimension of records."""
    dims: dict[str, int] = {}
    for v in variables:
        for d, n in zip(v.dims, v.values.shape, strict=True):
            if dims.setdefault(d, n) != n:
                raise ValueError(f"dimension {d} has two lengths")
    kinds = [CODES[v.values.dtype.str.lstrip("<>|=") if v.values.dtype.kind != "S" else "S1"] for v in variables]
    version = version or (5 if max(kinds, default=0) > 6 else 2)
    number = ">Q" if version == 5 else ">I"
    count = lambda n: struct.pack(number, n)
    text = lambda s: count(len(b := s.encode())) + b + b"\0" * (-len(b) % 4)

    def attributes(found: dict) -> bytes:
        out = struct.pack(">I", ATTRIBUTE if found else 0) + count(len(found))
        for k, x in found.items():
            if isinstance(x, str):
                raw, code, n = x.encode(), 2, len(x.encode())
            else:
                a = np.atleast_1d(np.asarray(x))
                a = a.astype(">f8") if a.dtype.kind == "f" and a.dtype.itemsize != 4 else a.astype(">i4") if a.dtype.str.lstrip("<>|=") not in CODES or version < 5 and a.dtype.itemsize == 8 and a.dtype.kind != "f" else a.astype(a.dtype.newbyteorder(">"))
                raw, code, n = a.tobytes(), CODES[a.dtype.str.lstrip("<>|=")], len(a)
            out += text(k) + struct.pack(">I", code) + count(n) + raw + b"\0" * (-len(raw) % 4)
        return out

    ids = {d: i for i, d in enumerate(dims)}
    is_record = [bool(v.dims) and v.dims[0] == record_dim for v in variables]
    row = [int(np.prod(v.values.shape[1 if r else 0 :], dtype=np.int64)) * v.values.dtype.itemsize for v, r in zip(variables, is_record)]
    sizes = [n + -n % 4 for n in row]
    lone = sum(is_record) == 1
    records = dims.get(record_dim, 0) if record_dim else 0
    head = b"CDF" + bytes([version]) + count(records)
    head += struct.pack(">I", DIMENSION if dims else 0) + count(len(dims)) + b"".join(text(d) + count(0 if d == record_dim else n) for d, n in dims.items())
    head += attributes(attrs or {}) + struct.pack(">I", VARIABLE if variables else 0) + count(len(variables))
    own = [text(v.name) + count(len(v.dims)) + b"".join(count(ids[d]) for d in v.dims) + attributes(v.attrs) + struct.pack(">I", k) + count(min(s, (1 << 32) - 4 if version < 5 else s)) for v, k, s in zip(variables, kinds, sizes)]
    width = 4 if version == 1 else 8
    at = len(head) + sum(len(o) + width for o in own)
    begins = [0] * len(variables)
    for wanted in (False, True):
        for i, r in enumerate(is_record):
            if r == wanted:
                begins[i] = at
                at += sizes[i]
    sink.write(head + b"".join(o + b.to_bytes(width, "big") for o, b in zip(own, begins)))
    big = [v.values.astype(v.values.dtype.newbyteorder(">")) if v.values.dtype.itemsize > 1 and v.values.dtype.kind != "S" else v.values for v in variables]
    total = len(head) + sum(len(o) + width for o in own)
    for a, r, n in zip(big, is_record, row):
        if not r:
            sink.write(a.tobytes() + b"\0" * (-n % 4))
            total += n + -n % 4
    mine = [(a, n) for a, r, n in zip(big, is_record, row) if r]
    for first in range(0, records, 4096):
        some = min(4096, records - first)
        parts = [np.zeros((some, n if lone else n + -n % 4), np.uint8) for _, n in mine]
        for p, (a, n) in zip(parts, mine):
            p[:, :n] = np.frombuffer(np.ascontiguousarray(a[first : first + some]).tobytes(), np.uint8).reshape(some, n)
        whole = np.concatenate(parts, axis=1) if parts else np.zeros((some, 0), np.uint8)
        sink.write(whole.tobytes())
        total += whole.size
    return total
