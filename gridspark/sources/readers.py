"""Sources: files, station and buoy records, matrices, retention."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {"lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x"), "level": ("level", "depth", "soil_level"), "time": ("time", "ts", "timestamp")}
STATION_VARIABLES = ("temperature_2m", "relative_humidity", "pressure_surface", "wind_speed", "precipitation")


def normalised(df: DataFrame) -> DataFrame:
    """Coordinates under their usual names; of several aliases the first there is."""
    for name, known in ALIASES.items():
        found = next((c for c in known if c in df.columns), None)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def read_cells(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Cells from parquet, orc, csv, json or NetCDF; what else Spark reads by its name."""
    if kind == "netcdf":
        from .netcdf_source import register

        register(spark)
    reader = spark.read.format(kind).options(**options)
    return normalised((reader.schema(schema) if schema else reader).load(path))


def retained(df: DataFrame, days: int, as_of: Column, ts: str = "time") -> DataFrame:
    """Rows not older than ``days`` at ``as_of``; the filter reaches the scan."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def station_observations(df: DataFrame, keys: list[str], variables=STATION_VARIABLES) -> DataFrame:
    """Known variables of station rows, unknown columns dropped."""
    return df.select(*keys, *[c for c in variables if c in df.columns])


def buoy_profile(profiles: DataFrame) -> DataFrame:
    """Maps depth to value (water_temperature, salinity, current_u, current_v;
    the last three may be null) as rows by depth. Depths are those of the
    temperature; what another map has no value for is null."""
    rows = profiles.select(*[c for c, t in profiles.dtypes if not t.startswith("map")], *[c for c, t in profiles.dtypes if t.startswith("map")], F.explode(F.map_entries("water_temperature")).alias("e"))
    value = lambda c: F.try_element_at(F.col(c), F.col("e.key")).alias(c) if c in profiles.columns else F.lit(None).cast("double").alias(c)
    keep = [c for c, t in profiles.dtypes if not t.startswith("map")]
    return rows.select(*keep, F.col("e.key").alias("depth"), F.col("e.value").alias("water_temperature"), *map(value, ("salinity", "current_u", "current_v")))


def matrix_cells(df: DataFrame, value: str, lat: str, lon: str) -> DataFrame:
    """A nested array with its axes (one row a matrix) as cells."""
    keep = [c for c in df.columns if c not in (value,)]
    out = df.select(*keep, F.posexplode(value).alias("lat_idx", "_row")).select(*keep, "lat_idx", F.posexplode("_row").alias("lon_idx", "value"))
    at = lambda axis, i: F.try_element_at(F.col(axis), F.col(i) + 1)
    return out.select(*[c for c in keep if c not in (lat, lon)], "lat_idx", "lon_idx", at(lat, "lat_idx").alias("lat"), at(lon, "lon_idx").alias("lon"), "value")


def estimated_bytes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.count("value") * 8).alias("bytes"))


def from_mapping(kind: type, data: Any) -> Any:
    """A dataclass from nested mappings, as of a configuration file: unknown keys
    are ignored, missing ones keep their defaults."""
    if not (isinstance(data, dict) and is_dataclass(kind)):
        return data
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    values = {}
    for k, v in data.items():
        if k not in known:
            continue
        hint = hints[k]
        if is_dataclass(hint):
            v = from_mapping(hint, v)
        elif get_origin(hint) is list and isinstance(v, list):
            v = [from_mapping(get_args(hint)[0], x) for x in v]
        elif get_origin(hint) is dict and isinstance(v, dict):
            v = {a: from_mapping(get_args(hint)[1], b) for a, b in v.items()}
        values[k] = v
    return kind(**values)


@dataclass
class StreamConfig:
    buffer_mb: int = 1024
    workers: int = 64
    retention_days: int = 30
