"""The stochastic ensemble Kalman filter, by areas.

Observations are taken one after the other, and each changes the cells within its
reach, whose values the next ones read. Two observations that lie further apart than
twice the reach touch no common cell, and their order does not matter. The globe is
cut into tiles at least that wide, in four colours, so that tiles of one colour lie a
tile apart: those are updated in parallel, each from its own cells and those around it,
and the colours follow each other. The result is that of the sequential filter with
the observations in the order of (colour, obs_id); no task holds a field.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import DEGREE_KM, finite, haversine

EARTH_KM = 6371.0
#: How many radii an observation reaches; the Gaussian one is below 1e-16 there.
REACH = {"gaspari_cohn": 2.0, "gaspari_cohn_cut": 2.0, "linear": 1.0, "gaussian": 6.1}


def normal(seed: int, *parts) -> float:
    """A standard normal number for a seed and identifiers, from the digits of their MD5."""
    h = hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()
    u, v = ((int(h[k : k + 13], 16) + 0.5) / 16**13 for k in (0, 13))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def taper(kind: str, c: np.ndarray) -> np.ndarray:
    if kind == "gaussian":
        return np.where(c < REACH[kind], np.exp(-(c**2)), 0)
    if kind == "gaspari_cohn_cut":
        whole = taper("gaspari_cohn", c)
        return np.where(whole > 1e-6, whole, 0)
    if kind != "gaspari_cohn":
        return np.maximum(0, 1 - c)
    safe = np.where(c > 0, c, 1)
    near = 1 - 5 / 3 * c**2 + 5 / 8 * c**3 + c**4 / 2 - c**5 / 4
    far = 4 - 5 * c + 5 / 3 * c**2 + 5 / 8 * c**3 - c**4 / 2 + c**5 / 12 - 2 / (3 * safe)
    return np.where(c <= 1, near, np.where(c < 2, np.maximum(far, 0), 0))


def distance(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    a = np.sin(np.radians(lat - lat0) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lat0)) * np.sin(np.radians(lon - lon0) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(a)))


def band_of(lat: Column, tile_km: float) -> Column:
    return F.floor((lat + 90) / (tile_km / DEGREE_KM))


def tiles_of(band: Column, tile_km: float) -> Column:
    """How many tiles a band has: an even number, each as wide as ``tile_km`` where
    the band is narrowest, or a single one."""
    high = tile_km / DEGREE_KM
    edge = F.least(F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90)), F.lit(90.0))
    cos = F.cos(F.radians(edge))
    s = math.sin(min(tile_km / (2 * EARTH_KM), math.pi / 2))
    n = F.floor(360 / F.degrees(2 * F.asin(F.least(F.lit(1.0), s / F.greatest(cos, F.lit(1e-9))))))
    return F.when(cos <= s, 1).otherwise(F.greatest(n - n % 2, F.lit(1))).cast("long")


def tile_of(lon: Column, n: Column) -> Column:
    return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n), n - 1)


def coloured(obs: DataFrame, tile_km: float, lat: str = "p_lat", lon: str = "p_lon") -> DataFrame:
    """``band``, ``tile`` and ``colour`` (0 to 3) of each observation."""
    out = obs.withColumn("band", band_of(F.col(lat), tile_km))
    out = out.withColumn("tile", tile_of(F.col(lon), tiles_of(F.col("band"), tile_km)))
    return out.withColumn("colour", (2 * (F.col("band") % 2) + F.col("tile") % 2).cast("int"))


def around(cells: DataFrame, tile_km: float) -> DataFrame:
    """Each cell with the tiles it lies in or beside: band, tile."""
    own = band_of(F.col("lat"), tile_km)
    out = cells.withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
    n = tiles_of(F.col("band"), tile_km)
    at = tile_of(F.col("lon"), n)
    return out.withColumn("tile", F.explode(F.array_distinct(F.array(*(F.pmod(at + k, n) for k in (-1, 0, 1))))))


def nearest(obs: DataFrame, cells: DataFrame, steps=(2.0, 20.0, 720.0)) -> DataFrame:
    """``obs`` with c_lat and c_lon, the cell of the group with the least sum of
    differences in latitude and longitude, the first by (lat, lon) of several.
    Cells are looked for in squares of ``steps`` degrees and those beside them, the
    next step only for observations that are further from any cell than the last."""
    found, todo = None, obs
    for step in steps:
        bins = lambda lat, lon: (F.floor(lat / step), F.floor(lon / step))  # noqa: B023, E731
        a, o = bins(F.col("lat"), F.col("lon"))
        have = cells.select("group", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), a.alias("_a"), o.alias("_o"))
        a, o = bins(F.col("p_lat"), F.col("p_lon"))
        want = todo.withColumns({"_a": F.explode(F.array(a - 1, a, a + 1))}).withColumn("_o", F.explode(F.array(o - 1, o, o + 1)))
        d = F.abs(F.col("c_lat") - F.col("p_lat")) + F.abs(F.col("c_lon") - F.col("p_lon"))
        met = want.join(have, ["group", "_a", "_o"]).groupBy(*obs.columns).agg(F.min(F.struct(d.alias("d"), "c_lat", "c_lon")).alias("_c"))
        met = met.where(F.col("_c.d") <= step).select(*obs.columns, "_c.c_lat", "_c.c_lon")
        if step == steps[-1]:
            return met if found is None else found.unionByName(met)
        from ..plans.scratch import materialise

        met = materialise(met, "nearest")
        found = met if found is None else found.unionByName(met)
        todo = obs.join(found.select("group", "obs_id"), ["group", "obs_id"], "left_anti")
        if todo.isEmpty():
            return found


def _advance(cells: pd.DataFrame, obs: pd.DataFrame, radius_km: float, kind: str, seed: int) -> pd.DataFrame:
    """The cells of a tile that its observations change."""
    cells = cells.sort_values(["lat", "lon"]).drop_duplicates(["lat", "lon"])
    lat, lon = cells["lat"].to_numpy(float), cells["lon"].to_numpy(float)
    e = np.array(cells["e"].tolist(), float).T
    place = {(a, o): i for i, (a, o) in enumerate(zip(lat, lon))}
    touched = np.zeros(len(cells), bool)
    for o in obs.sort_values("obs_id").itertuples():
        rho = taper(kind, distance(lat, lon, o.p_lat, o.p_lon) / radius_km)
        near = np.flatnonzero(rho > 0)
        h = e[:, place[o.c_lat, o.c_lon]]
        h = np.where(np.isfinite(h), h, np.nanmean(h) if np.isfinite(h).any() else np.nan)
        if not len(near) or np.isnan(h).any():
            continue
        x = e[:, near]
        gain = ((x - x.mean(0)) * (h - h.mean())[:, None]).mean(0) * rho[near] / (h.var() + o.error**2)
        noise = o.error * np.array([normal(seed, o.obs_id, m) for m in range(len(h))])
        e[:, near] = x + gain * (o.value + noise - h)[:, None]
        touched[near] = True
    out = cells.loc[touched, ["group", "lat", "lon"]].copy()
    out["e"] = pd.Series(list(e.T[touched]), index=out.index, dtype=object)
    return out


def filtered(members: DataFrame, obs: DataFrame, group: str, radius_km: float, inflation: float = 1.0, seed: int = 0, kind: str = "gaspari_cohn", tile_km: float | None = None) -> DataFrame:
    """The ensemble after all observations: group, lat, lon, ``e`` (the members'
    values in the order of ``member``), mean, spread.

    Members: ``group``, member, lat, lon, value; observations: ``group``, obs_id
    (one a group), p_lat, p_lon, value, error (1 where it is not positive). A null
    value of an observation changes nothing; of a cell it stays missing, and a cell
    that lacks a member counts as missing there. ``tile_km``, where it is given, must
    leave tiles as wide as the reach of the observations demands.
    """
    from ..plans.scratch import materialise

    kind_of = dict(members.dtypes)[group]
    named = members.select(F.col(group).alias("group"), "member", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("value").cast("double").alias("value"))
    every = named.groupBy("group").agg(F.sort_array(F.collect_set("member")).alias("_m"))  # an ensemble is small
    state = named.groupBy("group", "lat", "lon").agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("_v")).join(every, "group")
    missing = F.lit(float("nan"))
    state = materialise(state.select("group", "lat", "lon", F.transform("_m", lambda m: F.coalesce(F.try_element_at("_v", m), missing)).alias("e")), "ensemble")
    good = obs.where(finite(F.col("value")).isNotNull()).select(F.col(group).alias("group"), "obs_id", F.col("p_lat").cast("double").alias("p_lat"), F.col("p_lon").cast("double").alias("p_lon"), F.col("value").cast("double").alias("value"), F.when(F.col("error") > 0, F.col("error")).otherwise(1.0).cast("double").alias("error"))
    good = materialise(nearest(good, state), "observed")
    reach = REACH.get(kind, 1.0) * radius_km
    offset = good.agg(F.max(haversine(F.col("p_lat"), F.col("p_lon"), F.col("c_lat"), F.col("c_lon")))).first()[0] or 0.0
    least = max(2 * reach, reach + offset) * 1.001
    if tile_km is not None and tile_km < least:
        raise ValueError(f"tiles must be {least:.0f} km wide at least")
    width = tile_km or least
    good = materialise(coloured(good, width), "coloured")
    schema = f"group {kind_of}, lat double, lon double, e array<double>"
    for colour in sorted(r.colour for r in good.select("colour").distinct().collect()):  # four at most
        mine = good.where(F.col("colour") == colour)
        local = around(state, width).join(mine.select("group", "band", "tile").distinct(), ["group", "band", "tile"], "left_semi")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _advance(left, right, radius_km, kind, seed)

        changed = local.groupBy("group", "band", "tile").cogroup(mine.groupBy("group", "band", "tile")).applyInPandas(run, schema)
        changed = changed.select("group", "lat", "lon", F.col("e").alias("_e"))
        state = materialise(state.join(changed, ["group", "lat", "lon"], "left").select("group", "lat", "lon", F.coalesce("_e", "e").alias("e")), "ensemble")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.col("e")) / F.size("e")
    out = state.withColumn("mean", mean).withColumn("e", F.transform("e", lambda x: F.col("mean") + inflation * (x - F.col("mean"))))
    spread = F.sqrt(total(F.transform("e", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / F.size("e"))
    return out.select("group", "lat", "lon", "e", "mean", spread.alias("spread"))
