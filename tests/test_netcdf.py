"""Classic NetCDF by its bytes, and the data source on top of it."""

import datetime as dt
import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.sources import netcdf, readers, sinks
from gridspark.sources import netcdf_source as ns
from gridspark.sources.netcdf import Written


class Bytes:
    def __init__(self, data):
        self.data, self.read, self.path = data, 0, "x"

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def made(variables, **options):
    sink = io.BytesIO()
    assert netcdf.write_file(sink, variables, **options) == len(sink.getvalue())
    return Bytes(sink.getvalue())


def test_the_bytes_of_a_small_file():
    """The header of the format's description, by hand."""
    file = made([Written("v", ["x"], np.array([1, 2, 3], np.int16), {"u": "m"})], version=1)
    want = b"CDF\1" + struct.pack(">I", 0) + struct.pack(">II", 10, 1) + struct.pack(">I", 1) + b"x\0\0\0" + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    want += struct.pack(">II", 11, 1) + struct.pack(">I", 1) + b"v\0\0\0" + struct.pack(">II", 1, 0) + struct.pack(">III", 12, 1, 1) + b"u\0\0\0" + struct.pack(">II", 2, 1) + b"m\0\0\0"
    want += struct.pack(">III", 3, 8, len(want) + 12) + struct.pack(">hhh", 1, 2, 3) + b"\0\0"
    assert file.data == want


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("n_record", [0, 1, 2, 3])
def test_values_come_back(version, n_record):
    rng = np.random.default_rng(n_record)
    kinds = [np.int8, np.int16, np.int32, np.float32, np.float64] + ([np.int64, np.uint16] if version == 5 else [])
    fixed = [Written(f"f{i}", ["y", "x"], rng.integers(-100 if np.dtype(k).kind != "u" else 0, 100, (3, 5)).astype(k), {"n": i, "w": [1.5, 2.5], "t": "é"}) for i, k in enumerate(kinds)]
    records = [Written(f"r{i}", ["t", "x"], rng.integers(0, 100, (7, 5)).astype(kinds[i])) for i in range(n_record)]
    file = made([*records, *fixed, Written("s", [], np.array(4.0))], attrs={"title": "a"}, record_dim="t", version=version)
    header = netcdf.read_header(file, len(file.data))
    assert header.version == version and header.records == (7 if n_record else 0) and header.attrs == {"title": "a"}
    for w in [*fixed, *records]:
        v = header.variables[w.name]
        assert v.attrs == w.attrs and v.record == (w.name[0] == "r")
        assert (netcdf.read_values(file, header, w.name) == w.values).all()
        assert (netcdf.read_values(file, header, w.name, 1, 3) == w.values[1:3]).all()
    assert netcdf.read_values(file, header, "s") == 4.0


def test_only_the_bytes_of_a_variable_and_its_records_are_read():
    values = {n: np.random.default_rng(0).random((50, 40, 30)) for n in "abc"}
    file = made([Written(n, ["time", "lat", "lon"], x) for n, x in values.items()], record_dim="time")
    header = netcdf.read_header(file, len(file.data))
    file.read = 0
    got = netcdf.read_values(file, header, "b", 10, 13)
    assert (got == values["b"][10:13]).all() and file.read == 3 * 40 * 30 * 8


def test_streaming_record_counts():
    file = made([Written("a", ["t"], np.arange(6.0)), Written("b", ["t"], np.arange(6.0))], record_dim="t")
    data = file.data[:4] + b"\xff\xff\xff\xff" + file.data[8:]
    assert netcdf.read_header(Bytes(data), len(data)).records == 6


def test_fill_scale_and_offset():
    v = netcdf.Variable("v", ["x"], {"_FillValue": -9, "missing_value": [7, 8], "scale_factor": 0.5, "add_offset": 10.0}, np.dtype(">i2"), 0, (4,), False)
    assert np.array_equal(netcdf.decoded(v, np.array([-9, 7, 2, 3], ">i2")), [np.nan, np.nan, 11, 11.5], equal_nan=True)


def test_damage_never_passes():
    file = made([Written("a", ["t", "x"], np.ones((4, 3))), Written("b", ["x"], np.arange(3.0))], attrs={"k": "v"}, record_dim="t")
    for n in range(len(file.data)):
        with pytest.raises(netcdf.Damaged):
            netcdf.read_header(Bytes(file.data[:n]), n)
    rng = np.random.default_rng(1)
    for _ in range(500):
        data = bytearray(file.data)
        data[rng.integers(0, 120)] = rng.integers(0, 256)
        try:
            header = netcdf.read_header(Bytes(bytes(data)), len(data))
            for v in header.variables:
                netcdf.read_values(Bytes(bytes(data)), header, v)
        except netcdf.Damaged:
            pass


def test_times():
    assert ns.times(np.array([0, 1.5]), "days since 2000-01-01").tolist() == [dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 2, 12)]
    assert ns.times(np.array([60]), "minutes since 2000-01-01 06:00:00").tolist() == [dt.datetime(2000, 1, 1, 7)]
    assert np.isnat(ns.times(np.array([1.0]), "furlongs since 2000-01-01")).all() and np.isnat(ns.times(np.array([1.0]), None)).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two good files, a cut off one, one that is none, and what is no file of this kind."""
    path = tmp_path_factory.mktemp("nc")
    for k, start in enumerate(("2024-01-01T00:00:00Z", "2024-03-01T00:00:00Z")):
        t, la, lo = np.arange(6) * 3600.0, np.array([-10.0, 0, 10]), np.array([0.0, 90, 180, 270])
        x = np.arange(72.0).reshape(6, 3, 4) + 100 * k
        x[0, 0, 0] = np.nan
        variables = [
            Written("time", ["time"], t, {"units": "seconds since 2024-01-01 00:00:00"}), Written("latitude", ["latitude"], la), Written("lon", ["lon"], lo),
            Written("temperature", ["time", "latitude", "lon"], x.astype(np.float32), {"_FillValue": np.float32(5)}), Written("wind", ["time", "latitude", "lon"], -x),
            Written("mask", ["lon", "latitude"], np.arange(12).reshape(4, 3).astype(np.int8)), Written("label", ["latitude", "letters"], np.array([[b"a", b"b"]] * 3, "S1")),
        ]
        with open(path / f"f{k}.nc", "wb") as f:
            netcdf.write_file(f, variables, {"time_coverage_start": start}, "time")
    whole = (path / "f0.nc").read_bytes()
    (path / "cut.nc").write_bytes(whole[:-100])
    (path / "none.nc").write_bytes(b"HDF no such thing")
    (path / "notes.txt").write_text("x")
    return f"file://{path}"


@pytest.mark.parametrize("split", [1 << 26, 200])
def test_cells_of_files(spark, folder, split):
    cells = readers.read_cells(spark, folder, "netcdf", splitBytes=split)
    assert cells.columns == [c.split()[0] for c in ns.GRID.split(", ")]
    rows = cells.collect()
    assert len(rows) == 2 * (72 * 2 + 12)
    by = {(r.file[-5:-3], r.variable, r.time_idx, r.lat_idx, r.lon_idx): r for r in rows}
    r = by["f1", "temperature", 2, 1, 3]
    assert (r.value, r.lat, r.lon, r.time, r.level, r.lev_idx) == (131.0, 0.0, 270.0, dt.datetime(2024, 1, 1, 2), None, 0)
    assert by["f0", "temperature", 0, 0, 0].value is None and by["f0", "temperature", 0, 1, 1].value is None and by["f0", "wind", 0, 1, 1].value == -5
    assert by["f0", "mask", 0, 2, 1].value == 5 and by["f0", "mask", 0, 2, 1].time is None


@pytest.mark.parametrize("split", [1 << 26, 200])
def test_filters_are_pushed_down(spark, folder, split):
    cells = readers.read_cells(spark, folder, "netcdf", splitBytes=split)
    some = cells.where("variable = 'wind' AND time_idx >= 1 AND time_idx < 3 AND value < -20")
    assert {r.time_idx for r in some.collect()} == {1, 2} and some.count() == cells.where("concat(variable, '') = 'wind' AND time_idx + 0 IN (1, 2) AND value < -20").count()
    assert cells.where("variable IN ('mask', 'wind')").count() == 2 * 84 and cells.where("variable = 'mask' AND time_idx = 1").count() == 0
    reader = ns.NetCDFReader({"path": folder, "splitbytes": str(split)}, None)
    left = list(reader.pushFilters([ns.EqualTo(("variable",), "wind"), ns.GreaterThan(("time_idx",), 3), ns.LessThanOrEqual(("value",), 1.0)]))
    assert left == [ns.LessThanOrEqual(("value",), 1.0)] and reader.variables == {"wind"} and reader.first == 4
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * 2 * 12


def test_damaged_missing_and_expired_files_are_listed(spark, folder):
    ns.register(spark)
    listed = spark.read.format("netcdf").options(layout="files", retentionDays=30, asOf="2024-03-05").load(folder)
    got = {r.file.rsplit("/", 1)[1]: r for r in listed.collect()}
    assert {k: r.status for k, r in got.items()} == {"f0.nc": "expired", "f1.nc": "read", "cut.nc": "damaged", "none.nc": "damaged"}
    assert got["f1.nc"].variables == ["mask", "temperature", "wind"] and got["f1.nc"].records == 6 and got["cut.nc"].error and got["f1.nc"].coverage_start == dt.datetime(2024, 3, 1)
    kept = readers.read_cells(spark, folder, "netcdf", retentionDays=30, asOf="2024-03-05")
    assert {r.file[-5:] for r in kept.select("file").distinct().collect()} == {"f1.nc"}
    assert [r.status for r in spark.read.format("netcdf").option("layout", "files").load(folder + "/nowhere.nc").collect()] == ["missing"]
    assert readers.read_cells(spark, folder + "/nowhere.nc", "netcdf").count() == 0


def odd(spark):
    at = dt.datetime(2024, 5, 1, 1, 2, 3, 456789)
    rows = [(1, "a", 1.5, True, at, at.date(), b"\0x\0", 7), (2, None, None, None, None, None, None, None), (3, "", float("inf"), False, at, at.date(), b"", -7), (4, "é\0", -0.0, True, at, at.date(), b"yy", 0)]
    return spark.createDataFrame([(*r, t) for r in rows for t in ("t/1", "", None)], "id long, s string, d double, b boolean, ts timestamp_ntz, day date, raw binary, small smallint, tenant_id string")


def test_results_of_tenants_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    df = odd(spark)
    sinks.write_results(df, path, run="2024-05-01")
    names = sorted(str(p.relative_to(tmp_path / "results")) for p in (tmp_path / "results").glob("**/*.nc"))
    assert names == ["%empty/simulation_2024-05-01.nc", "%null/simulation_2024-05-01.nc", "t%2F1/simulation_2024-05-01.nc"]
    back = spark.read.format("netcdf").option("layout", "table").load(path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    listed = json.loads((tmp_path / "results/_runs/2024-05-01.json").read_text())["files"]
    assert sum(f["rows"] for f in listed) == 12 and not list((tmp_path / "results").glob(".staging*"))


def test_large_tenants_have_several_files(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").otherwise("small").alias("tenant_id"))
    sinks.write_results(df, path, run="r", rows=500)
    big = list((tmp_path / "results/big").glob("simulation_r-*.nc"))
    assert len(big) >= 7 and max(p.stat().st_size for p in big) < 2 * 5000 * 8
    assert spark.read.format("netcdf").option("layout", "table").load(path).distinct().count() == 5000


def test_a_run_is_written_once_or_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, tenant_id string")
    sinks.write_results(df, path, run="one")
    sinks.write_results(df, path, run="two")
    with pytest.raises(Exception, match="there already"):
        sinks.write_results(df, path, run="one")
    sinks.write_results(df.where("id = 1"), path, run="one", mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "results").glob("**/*.nc")) == ["simulation_one.nc", "simulation_two.nc", "simulation_two.nc"]
    assert not list((tmp_path / "results").glob(".staging*"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    df = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("s"), (F.col("id") % 3).cast("string").alias("tenant_id"))
    with pytest.raises(Exception):
        ns.register(spark)
        df.sortWithinPartitions("tenant_id").write.format("netcdf").options(by="tenant_id", run="r").mode("append").save(path)
    assert not list(tmp_path.glob("results/*")) and not list(tmp_path.glob("results/.*"))


def test_fields_are_written_and_read_as_cells(spark, tmp_path):
    path = f"file://{tmp_path}/fields"
    cells = spark.range(240).select(
        F.concat(F.lit("d"), F.col("id") % 2).alias("dataset"), F.element_at(F.array(F.lit("u"), F.lit("v")), (F.col("id") / 2 % 2 + 1).cast("int")).alias("variable"),
        F.timestamp_seconds(F.floor(F.col("id") / 60) * 3600).cast("timestamp_ntz").alias("time"), (F.col("id") % 5 * 10.0).alias("lat"), (F.floor(F.col("id") / 20) % 3).cast("double").alias("lon"), F.col("id").cast("double").alias("value"), F.lit("2024-01-01").alias("time_coverage_start"),
    )
    sinks.write_fields(cells, path, "dataset")
    back = readers.read_cells(spark, path, "netcdf").where("value IS NOT NULL").withColumn("dataset", F.element_at(F.split("file", "/"), -2))
    names = ["dataset", "variable", "time", "lat", "lon", "value"]
    assert sorted(map(str, back.select(names).collect())) == sorted(map(str, cells.select(names).collect()))
    assert {r.coverage_start for r in spark.read.format("netcdf").option("layout", "files").load(path).collect()} == {dt.datetime(2024, 1, 1)}
