"""``spark.read.format("netcdf")`` and ``df.write.format("netcdf")``.

Reading. ``layout``:

* ``grid`` (default): a row for each value of each gridded variable, with the
  schema GRID. Equality on ``variable`` and ``file`` and ranges of ``time_idx`` are
  pushed down, so that only the bytes of wanted variables and records are read. A
  file up to ``splitBytes`` is one task, which reads its header as well; a larger one
  is cut by variable and range of records.
* ``table``: the record variables of files that this format has written, a row a
  record; give the schema, or the first file's is taken. With ``run`` the files of
  that run alone.
* ``files``: a row for each file with what can be said of it (schema FILES): read,
  expired, damaged with the error, or missing.

A missing or damaged file gives no rows in the first two, and a line in the last.
With ``retentionDays`` and ``asOf`` files whose attribute ``time_coverage_start`` is
older give no rows; without the attribute a file counts as new.

Writing. A file for each value of ``by`` and run, in parts of ``rowsPerFile`` rows:
``<path>/<value>/simulation_<run>.nc``, or ``..._<run>-00001.nc`` and so on where there
are several. Rows of a value must lie together in their partitions (as
``sinks.write_results`` deals them). Tasks write into a staging folder; the commit
moves what the successful attempts wrote and lists it in ``<path>/_runs/<run>.json``,
an abort deletes the folder. A run is written once, or again with ``overwrite``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .netcdf import Damaged, Header, Written, decoded, read_header, read_values, write_file
from .readers import ALIASES

GRID = "file string, variable string, time_idx int, time timestamp_ntz, lev_idx int, level double, lat_idx int, lat double, lon_idx int, lon double, value double"
FILES = "file string, status string, error string, bytes long, records long, variables array<string>, coverage_start timestamp_ntz"
ROLES = ("time", "level", "lat", "lon")
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 1 << 16
ROWS_PER_FILE = 1 << 20
EPOCH = np.datetime64("1970-01-01T00:00:00", "us")
UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def role(dim: str) -> str | None:
    return next((r for r in ROLES if dim in ALIASES[r]), None)


def times(values: np.ndarray, units: str | None) -> np.ndarray:
    """Values of a time axis in microseconds since 1970, NaT where its units say nothing."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(\S+)(?:[T ]+(\S+?))?\s*Z?\s*", units or "")
    try:
        start = np.datetime64(m[2].rstrip("Z") if not m[3] else f"{m[2]}T{m[3].rstrip('Z')}", "us")
        return np.round(values * UNITS[m[1]]).astype("timedelta64[us]") + start
    except (TypeError, KeyError, ValueError):
        return np.full(len(values), np.datetime64("NaT", "us"))


def gridded(header: Header) -> dict[str, dict[str, int]]:
    """Variables that are fields: for each the place of every role among its dimensions."""
    found = {}
    for v in header.variables.values():
        roles = [role(d) for d in v.dims]
        if roles and None not in roles and len(set(roles)) == len(roles) and not (v.name == v.dims[0] and len(roles) == 1) and v.dtype.kind in "iuf":
            found[v.name] = {r: i for i, r in enumerate(roles)}
    return found


def coverage_start(header: Header) -> np.datetime64 | None:
    try:
        return np.datetime64(re.sub(r"Z$", "", str(header.attrs["time_coverage_start"]).strip()), "us")
    except (KeyError, ValueError):
        return None


@dataclass
class Part(InputPartition):
    file: str
    variable: str | None = None
    first: int = 0
    last: int | None = None


class NetCDFReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.layout = dict(options), schema, options.get("layout", "grid").lower()
        self.variables: set[str] | None = None
        self.files: set[str] | None = None
        self.first, self.last = 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            if self.layout != "grid" or not self._push(f):
                yield f

    def _push(self, f) -> bool:
        kind, column = type(f), getattr(f, "attribute", None)
        if column in (("variable",), ("file",)) and kind in (EqualTo, In):
            values = {f.value} if kind is EqualTo else set(f.value)
            name = "variables" if column == ("variable",) else "files"
            known = getattr(self, name)
            setattr(self, name, values if known is None else known & values)
        elif column == ("time_idx",) and kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
            self.first = max(self.first, f.value + (kind is GreaterThan))
            self.last = min(self.last, f.value + 1) if kind is EqualTo else self.last
        elif column == ("time_idx",) and kind in (LessThan, LessThanOrEqual):
            self.last = min(self.last, f.value + (kind is LessThanOrEqual))
        else:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in list_files(self.options["path"]):
            if self.files is not None and path not in self.files or not of_run(path, self.options.get("run")):
                continue
            if self.layout == "grid" and size > int(self.options.get("splitbytes", SPLIT_BYTES)):
                out += self._split(path, size)
            else:
                out.append(Part(path))
        if not out and self.layout == "files":
            out.append(Part(pafs.FileSystem.from_uri(self.options["path"])[1]))
        return out

    def _split(self, path: str, size: int) -> list[Part]:
        """By variable and range of records; a damaged file is left to its task."""
        try:
            with opened(self.options["path"], path) as file:
                header = read_header(file, size)
        except (Damaged, OSError):
            return [Part(path)]
        most, out = int(self.options.get("splitbytes", SPLIT_BYTES)), []
        for name, roles in gridded(header).items():
            v = header.variables[name]
            if self.variables is not None and name not in self.variables:
                continue
            steps = max(1, most // max(1, v.row_bytes)) if roles.get("time") == 0 else v.shape[0]
            out += [Part(path, name, a, a + steps) for a in range(0, max(1, v.shape[0]), max(1, steps))]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        if self.layout == "files":
            yield self._described(partition.file)
            return
        try:
            with opened(self.options["path"], partition.file) as file:
                header = read_header(file, file.size())
                if not self._expired(header):
                    yield from self._cells(file, header, partition) if self.layout == "grid" else self._rows(file, header)
        except (Damaged, OSError):
            return  # no rows; layout "files" tells

    def _expired(self, header: Header) -> bool:
        days, start = self.options.get("retentiondays"), coverage_start(header)
        if days is None or start is None:
            return False
        now = np.datetime64(self.options.get("asof") or dt.datetime.now(dt.UTC).replace(tzinfo=None), "us")
        return bool(start < now - np.timedelta64(int(days), "D"))

    def _cells(self, file, header: Header, part: Part) -> Iterator[pa.RecordBatch]:
        axes = {}
        for d in header.dims:
            v = header.variables.get(d)
            axes[role(d)] = (v, decoded(v, read_values(file, header, d))) if v is not None and len(v.dims) == 1 and v.dtype.kind in "iuf" else (None, None)
        for name, roles in gridded(header).items():
            if part.variable not in (None, name) or self.variables is not None and name not in self.variables:
                continue
            v = header.variables[name]
            on_time = roles.get("time") == 0
            first, last = part.first, v.shape[0] if part.last is None else min(part.last, v.shape[0])
            if on_time:
                first, last = max(first, self.first), min(last, self.last)
            elif "time" not in roles and (self.first > 0 or self.last <= 0):
                continue
            step = max(1, BATCH_ROWS // max(1, v.row_bytes // v.dtype.itemsize))
            for a in range(first, last, step):
                yield self._batch(file, header, name, roles, axes, a, min(last, a + step))

    def _batch(self, file, header: Header, name: str, roles: dict, axes: dict, a: int, b: int) -> pa.RecordBatch:
        v = header.variables[name]
        values = decoded(v, read_values(file, header, name, a, b))
        place = {r: i for i, r in enumerate(sorted(roles, key=roles.get))}
        index = np.indices(values.shape, dtype=np.int32).reshape(len(values.shape), -1) if values.size else np.zeros((len(values.shape), 0), np.int32)
        columns = {"file": pa.array([file.path] * values.size, pa.string()), "variable": pa.array([name] * values.size, pa.string())}
        flat, keep = values.ravel(), np.ones(values.size, bool)
        for r, idx, coordinate in (("time", "time_idx", "time"), ("level", "lev_idx", "level"), ("lat", "lat_idx", "lat"), ("lon", "lon_idx", "lon")):
            kind = pa.timestamp("us") if r == "time" else pa.float64()
            if r not in place:
                columns[idx], columns[coordinate] = pa.array(np.zeros(values.size, np.int32)), pa.nulls(values.size, kind)
                continue
            i = index[place[r]] + (a if place[r] == 0 else 0)
            if r == "time" and place[r] > 0:
                keep &= (i >= self.first) & (i < self.last)
            axis, at = axes.get(r, (None, None))
            x = at[i] if at is not None else None
            columns[idx] = pa.array(i.astype(np.int32))
            columns[coordinate] = pa.nulls(values.size, kind) if x is None else pa.array(times(x, axis.attrs.get("units")), kind) if r == "time" else pa.array(x, kind, from_pandas=True)
        columns["value"] = pa.array(flat, pa.float64(), from_pandas=True)
        out = pa.RecordBatch.from_pydict({f.split()[0]: columns[f.split()[0]] for f in GRID.split(", ")})
        return out if keep.all() else out.filter(pa.array(keep))

    def _rows(self, file, header: Header) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        for a in range(0, header.records, BATCH_ROWS):
            b = min(header.records, a + BATCH_ROWS)
            columns = [column(file, header, f, a, b) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def _described(self, path: str) -> pa.RecordBatch:
        said = {"file": path, "status": "read", "error": None, "bytes": None, "records": None, "variables": None, "coverage_start": None}
        try:
            with opened(self.options["path"], path) as file:
                said["bytes"] = file.size()
                header = read_header(file, file.size())
                start = coverage_start(header)
                said |= {"records": header.records, "variables": sorted(gridded(header)), "coverage_start": start.item() if start is not None else None}
                said["status"] = "expired" if self._expired(header) else "read"
        except FileNotFoundError:
            said["status"] = "missing"
        except (Damaged, OSError) as e:
            said |= {"status": "damaged", "error": str(e)}
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.timestamp("us")]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(said.values(), kinds)], list(said))


class opened:
    """A file for reading at places, which knows its name and counts what is read."""

    def __init__(self, root: str, path: str):
        self.path, self.read = path, 0
        self.file = pafs.FileSystem.from_uri(root)[0].open_input_file(path)

    def read_at(self, n: int, at: int) -> bytes:
        self.read += n
        return self.file.read_at(n, at)

    def size(self) -> int:
        return self.file.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def list_files(root: str) -> list[tuple[str, int]]:
    """Files below a folder (or the one file), by name, with sizes; staged and hidden ones left out."""
    fs, path = pafs.FileSystem.from_uri(root)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(path) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(".nc") and not hidden(f.path))


def of_run(path: str, run: str | None) -> bool:
    return run is None or re.fullmatch(rf"simulation_{re.escape(run)}(-\d{{5}})?\.nc", path.rsplit("/", 1)[-1]) is not None


# Rows as record variables: strings as characters with their lengths, times in microseconds, nulls in a variable of their own.


def written(name: str, a: pa.Array) -> list[Written]:
    dims, out, t = ["row"], [], a.type
    if a.null_count:
        out.append(Written(f"{name}.null", dims, a.is_null().to_numpy(zero_copy_only=False).astype(np.int8)))
    if pa.types.is_string(t) or pa.types.is_binary(t) or pa.types.is_large_string(t):
        raw = [x or b"" for x in a.cast(pa.binary()).to_pylist()]
        width = max(1, max(map(len, raw), default=1))
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), "S1").reshape(len(raw), width)
        return [*out, Written(name, ["row", f"{name}.width"], grid, {"kind": "string" if not pa.types.is_binary(t) else "binary"}), Written(f"{name}.length", dims, np.array([len(x) for x in raw], np.int32))]
    if pa.types.is_timestamp(t):
        kind = {"kind": "timestamp" if t.tz else "timestamp_ntz", "units": "microseconds since 1970-01-01 00:00:00"}
        return [*out, Written(name, dims, np.asarray(a.cast(pa.timestamp("us", t.tz)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)), kind)]
    if pa.types.is_date(t):
        return [*out, Written(name, dims, np.asarray(a.cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)), {"kind": "date", "units": "days since 1970-01-01"})]
    if pa.types.is_boolean(t):
        return [*out, Written(name, dims, a.fill_null(False).to_numpy(zero_copy_only=False).astype(np.int8), {"kind": "boolean"})]
    if not (pa.types.is_integer(t) or pa.types.is_floating(t)):
        raise ValueError(f"{name}: {t} has no place in a classic file")
    return [*out, Written(name, dims, np.asarray(a.fill_null(0).to_numpy(zero_copy_only=False)), {"kind": str(t)})]


SQL_KINDS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double"}


def table_schema(header: Header) -> str:
    """Columns of a file's record variables, as DDL."""
    own = [v for v in header.variables.values() if v.record and "." not in v.name]
    return ", ".join(f"`{v.name}` {SQL_KINDS.get(v.attrs.get('kind', ''), v.attrs.get('kind', 'double'))}" for v in own)


def column(file, header: Header, f: pa.Field, a: int, b: int) -> pa.Array:
    """Records a to b of a column; null where the file has no such variable."""
    name, n = f.name, b - a
    if name not in header.variables:
        return pa.nulls(n, f.type)
    values, mask = read_values(file, header, name, a, b), None
    if f"{name}.null" in header.variables:
        mask = read_values(file, header, f"{name}.null", a, b).astype(bool)
    kind = header.variables[name].attrs.get("kind")
    if kind in ("string", "binary"):
        lengths = read_values(file, header, f"{name}.length", a, b)
        raw = [values[i].tobytes()[:k] if k else b"" for i, k in enumerate(lengths)]
        return pa.array(raw, pa.binary(), mask=mask).cast(f.type)
    values = values.astype(values.dtype.newbyteorder("="))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return pa.array(values, mask=mask).cast(pa.timestamp("us", "UTC") if kind == "timestamp" else pa.timestamp("us") if kind == "timestamp_ntz" else pa.date32()).cast(f.type)
    if kind == "boolean":
        values = values.astype(bool)
    return pa.array(values, mask=mask).cast(f.type)


def grid_variables(rows: pa.Table) -> list[Written]:
    """Cells (variable, value and any of time, level, lat, lon) as fields over the
    axes that occur; what no row has is missing."""
    axes = [r for r in ROLES if r in rows.column_names]
    values, places, out = rows.column("value").to_numpy(zero_copy_only=False).astype(float), [], []
    for r in axes:
        column_ = rows.column(r)
        raw = column_.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() if pa.types.is_timestamp(column_.type) else column_.to_numpy()
        at, place = np.unique(raw, return_inverse=True)
        attrs = {"units": "seconds since 1970-01-01 00:00:00"} if pa.types.is_timestamp(column_.type) else {}
        out.append(Written(r, [r], at / 1e6 if attrs else at.astype(float), attrs))
        places.append(place)
    names, which = np.unique(rows.column("variable").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    shape = tuple(len(w.values) for w in out)
    for k, name in enumerate(names):
        field = np.full(shape, np.nan)
        mine = which == k
        field[tuple(p[mine] for p in places)] = values[mine]
        out.append(Written(str(name), axes, field, {"_FillValue": float("nan")}))
    return out


@dataclass
class Files(WriterCommitMessage):
    """(staged, value of ``by``, rows) of the files that a task has written."""

    files: list[tuple[str, str, int]]


class NetCDFWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.root, self.by, self.run = options["path"], options.get("by"), options.get("run", "run")
        if not re.fullmatch(r"[\w.+-]+", self.run):
            raise ValueError("a run's name has letters, digits and . _ + - only")
        self.staging = f".staging-{self.run}-{uuid.uuid4().hex}"

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = self._fs()
        most, held, n, key, done = int(self.options.get("rowsperfile", ROWS_PER_FILE)), [], 0, None, []
        seen: set[str] = set()

        def flush():
            nonlocal held, n
            if n:
                name = f"{root}/{self.staging}/{uuid.uuid4().hex}.nc"
                self._file(fs, name, pa.Table.from_batches(held))
                done.append((name, key, n))
            held, n = [], 0

        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        for batch in iterator:
            keys = ["" if x is None else f"={x}" for x in batch.column(self.by).cast(pa.string()).to_pylist()] if self.by else ["=all"] * batch.num_rows
            start = 0
            while start < batch.num_rows:
                end = start + 1
                while end < batch.num_rows and keys[end] == keys[start]:
                    end += 1
                if keys[start] != key:
                    flush()
                    key = keys[start]
                    if key in seen and self.options.get("layout") == "grid":
                        raise ValueError(f"the rows of {key[1:]} do not lie together")
                    seen.add(key)
                while start < end:
                    take = end - start if self.options.get("layout") == "grid" else min(end - start, most - n)
                    held.append(batch.slice(start, take))
                    n, start = n + take, start + take
                    if n >= most and self.options.get("layout") != "grid":
                        flush()
        flush()
        return Files(done)

    def _file(self, fs: pafs.FileSystem, name: str, rows: pa.Table) -> None:
        attrs = {"run": self.run}
        if self.options.get("layout") == "grid":
            if "time_coverage_start" in rows.column_names:
                attrs["time_coverage_start"] = str(rows.column("time_coverage_start")[0].as_py()).replace(" ", "T")
            variables, record = grid_variables(rows), "time"
        else:
            variables, record = [w for c in rows.column_names for w in written(c, rows.column(c).combine_chunks())], "row"
        with fs.open_output_stream(name) as sink:
            write_file(sink, variables, attrs, record)

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = self._fs()
        listed = f"{root}/_runs/{self.run}.json"
        if fs.get_file_info(listed).type == pafs.FileType.File:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"run {self.run} is there already")
            with fs.open_input_stream(listed) as f:
                for old in json.loads(f.read())["files"]:
                    if fs.get_file_info(f"{root}/{old['file']}").type == pafs.FileType.File:
                        fs.delete_file(f"{root}/{old['file']}")
        by_key: dict[str, list[tuple[str, int]]] = {}
        for m in messages:
            for name, key, n in m.files if m else ():
                by_key.setdefault(key, []).append((name, n))
        done = []
        for key, files in sorted(by_key.items()):
            folder = quote(key[1:], safe="") or "%empty" if key else "%null"  # no escaped name is like these
            fs.create_dir(f"{root}/{folder}", recursive=True)
            for i, (name, n) in enumerate(files):
                final = f"{folder}/simulation_{self.run}{f'-{i + 1:05d}' if len(files) > 1 else ''}.nc"
                fs.move(name, f"{root}/{final}")
                done.append({"file": final, "by": key[1:] if key else None, "rows": n})
        fs.create_dir(f"{root}/_runs", recursive=True)
        with fs.open_output_stream(listed) as f:
            f.write(json.dumps({"run": self.run, "files": done}).encode())
        self._clear(fs, root)

    def abort(self, messages: list[Files | None]) -> None:
        self._clear(*self._fs())

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class NetCDF(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        layout = self.options.get("layout", "grid").lower()
        if layout != "table":
            return FILES if layout == "files" else GRID
        for path, size in list_files(self.options["path"]):
            if not of_run(path, self.options.get("run")):
                continue
            try:
                with opened(self.options["path"], path) as file:
                    return table_schema(read_header(file, size))
            except Damaged:
                continue
        raise ValueError("no file to take the schema from: give one")

    def reader(self, schema: StructType) -> NetCDFReader:
        return NetCDFReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> NetCDFWriter:
        return NetCDFWriter(self.options, overwrite)


def register(spark) -> None:
    """Makes the format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetCDF)
