"""Column expressions that the operators share. All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.0
OMEGA = 7.2921e-5
# Physical bounds of variables, as the cleaner and as the quality engine have them.
CLEANER_RANGES = {
    "temperature": (180.0, 330.0),
    "temperature_2m": (180.0, 320.0),
    "temperature_surface": (180.0, 330.0),
    "water_temperature": (271.0, 305.0),
    "sea_surface_temperature": (271.0, 305.0),
    "skin_temperature": (200.0, 330.0),
    "sea_ice_temperature": (200.0, 273.0),
    "relative_humidity": (0.0, 100.0),
    "specific_humidity": (0.0, 0.05),
    "pressure": (87000.0, 108500.0),
    "pressure_surface": (87000.0, 108500.0),
    "pressure_sea_level": (87000.0, 108500.0),
    "surface_pressure": (87000.0, 108500.0),
    "wind_speed": (0.0, 150.0),
    "wind_speed_10m": (0.0, 85.0),
    "u_wind": (-150.0, 150.0),
    "v_wind": (-150.0, 150.0),
    "wind_direction": (0.0, 360.0),
    "wind_direction_10m": (0.0, 360.0),
    "precipitation": (0.0, 1000.0),
    "salinity": (0.0, 42.0),
    "geopotential_height": (0.0, 50000.0),
    "vorticity": (-1e-2, 1e-2),
    "divergence": (-1e-3, 1e-3),
    "sea_ice_concentration": (0.0, 1.0),
    "sea_ice_thickness": (0.0, 50.0),
    "soil_moisture": (0.0, 1.0),
    "albedo": (0.0, 1.0),
    "cloud_cover": (0.0, 1.0),
}
ENGINE_RANGES = {
    "temperature": (180.0, 330.0),
    "temperature_2m": (180.0, 320.0),
    "water_temperature": (271.0, 305.0),
    "sea_surface_temperature": (271.0, 305.0),
    "skin_temperature": (200.0, 330.0),
    "sea_ice_temperature": (200.0, 273.0),
    "pressure": (87000.0, 108500.0),
    "surface_pressure": (87000.0, 108500.0),
    "pressure_sea_level": (87000.0, 108500.0),
    "wind_speed": (0.0, 100.0),
    "wind_speed_10m": (0.0, 85.0),
    "wind_direction": (0.0, 360.0),
    "wind_direction_10m": (0.0, 360.0),
    "u_wind": (-150.0, 150.0),
    "v_wind": (-150.0, 150.0),
    "relative_humidity": (0.0, 100.0),
    "specific_humidity": (0.0, 0.05),
    "precipitation": (0.0, 1000.0),
    "salinity": (0.0, 42.0),
    "sea_ice_concentration": (0.0, 1.0),
    "sea_ice_thickness": (0.0, 50.0),
    "soil_moisture": (0.0, 1.0),
    "albedo": (0.0, 1.0),
    "cloud_cover": (0.0, 1.0),
    "geopotential_height": (0.0, 50000.0),
    "shortwave_radiation": (0.0, 1500.0),
    "sensible_heat_flux": (-500.0, 500.0),
    "latent_heat_flux": (-500.0, 500.0),
    "evapotranspiration": (0.0, 100.0),
}


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def safe_ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; rounding cannot leave the domain of asin."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def gaspari_cohn(c: Column) -> Column:
    """Fifth-order compactly supported taper of the normalised distance: 1 at 0, 0 from 2 on."""
    near = F.lit(1.0) + c * c * (F.lit(-5 / 3) + c * (F.lit(5 / 8) + c * (F.lit(0.5) - c / 4)))
    safe = F.when(c > 0, c).otherwise(1.0)
    far = F.lit(4.0) - 5 * c + c * c * (F.lit(5 / 3) + c * (F.lit(5 / 8) + c * (c / 12 - F.lit(0.5)))) - F.lit(2 / 3) / safe
    return F.when(c <= 1, near).when(c < 2, F.greatest(far, F.lit(0.0))).otherwise(0.0)


def taper(kind: str, c: Column) -> Column:
    if kind == "gaspari_cohn":
        return gaspari_cohn(c)
    if kind == "gaspari_cohn_cut":  # without the last trace before its end
        return F.when(gaspari_cohn(c) > 1e-6, gaspari_cohn(c)).otherwise(0.0)
    return F.exp(-c * c) if kind == "gaussian" else F.greatest(F.lit(0.0), 1 - c)


def compare(value: Column, operator: Column | str, threshold: Column) -> Column:
    """``> >= < <= ==`` (to 1e-10); any other operator means ``>``."""
    op = F.lit(operator) if isinstance(operator, str) else operator
    found = F.when(op == ">=", value >= threshold).when(op == "<", value < threshold).when(op == "<=", value <= threshold)
    return found.when(op == "==", F.abs(value - threshold) < 1e-10).otherwise(value > threshold)


def range_of(variable: Column, rule: str = "first", ranges: dict[str, tuple[float, float]] | None = None) -> tuple[Column, Column]:
    """Bounds for a variable, null where there are none. By the rule ``exact`` a
    key must be the name (the cleaner's table), by ``first`` the first key that the
    lower-cased name contains holds (the engine's table), by ``longest`` the
    longest such key, which tells a surface temperature from a temperature."""
    ranges = ranges or (CLEANER_RANGES if rule == "exact" else ENGINE_RANGES)
    keys = sorted(ranges, key=len, reverse=True) if rule == "longest" else list(ranges)
    low = high = F.lit(None).cast("double")
    for key in reversed(keys):
        hit = variable == key if rule == "exact" else F.lower(variable).contains(key)
        low, high = F.when(hit, ranges[key][0]).otherwise(low), F.when(hit, ranges[key][1]).otherwise(high)
    return low, high


def semver(version: Column) -> Column:
    """``a.b[.c]`` as three numbers; (0, 0, 0) for anything else."""
    ok = version.rlike(r"^\d+\.\d+(\.\d+)?$")
    part = lambda i: F.when(ok, F.coalesce(F.try_element_at(F.split(version, r"\."), F.lit(i)).cast("int"), F.lit(0))).otherwise(0)
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Uniform in (0, 1), a function of the keys alone: the same on any partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def digest_uniform(seed: int, *keys: Column) -> Column:
    """As ``hash_uniform``, from the first 52 bits of the MD5 digest of the seed and
    keys as text (joined by colons, null keys left out): slower, but any engine that
    knows the digest works out the same noise."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def hash_normal(seed: int, *keys: Column, uniform=hash_uniform) -> Column:
    u, v = uniform(2 * seed, *keys), uniform(2 * seed + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def digest_normal(seed: int, *keys: Column) -> Column:
    return hash_normal(seed, *keys, uniform=digest_uniform)


def cell_size_km(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    return F.least((lat_max - lat_min) * DEGREE_KM, (lon_max - lon_min) * DEGREE_KM * F.cos(F.radians((lat_min + lat_max) / 2)))


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; 0 for a zero vector or other lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def matched(names: Column, wanted: str) -> Column:
    """Whether any of the names contains the wanted text."""
    return F.array_join(names, ",").contains(wanted)


def lead_seconds(start: Column, end: Column) -> Column:
    """Duration or lead time, in seconds."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(text: Column) -> Column:
    """The time that an ISO string names; null for anything else."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def array_reductions(a: Column) -> dict[str, Column]:
    """Mean, ends and norm of an array's numbers; null for an empty one."""
    x = F.transform(a, lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    some = F.size(x) > 0
    return {"mean": F.when(some, total / F.size(x)), "min": F.array_min(x), "max": F.array_max(x), "norm": F.when(some, F.sqrt(squares))}


def merged(entries: Column) -> Column:
    """A map of entries (key, value) in their order, of one key the last."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))
