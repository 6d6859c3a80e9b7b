"""Observations and their assimilation into gridded backgrounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import DEGREE_KM, finite, hash_normal, haversine, taper
from .enkf import filtered


def observations_from_cells(cells: DataFrame, variables: list[str], keys: list[str], error: float = 1.0) -> DataFrame:
    """Every finite cell of the wide variables as an observation row."""
    long = cells.unpivot(keys, variables, "variable", "value").withColumn("value", finite(F.col("value")))
    return long.where("value IS NOT NULL").withColumn("error", F.lit(error))


def in_window(obs: DataFrame, centre: Column, width_hours: float, ts: str = "ts") -> DataFrame:
    """Observations within half a window of the centre, ends included; one
    without a time is always in."""
    half = F.expr(f"INTERVAL '{round(width_hours * 1800)}' SECOND")
    return obs.where(F.col(ts).isNull() | F.col(ts).between(centre - half, centre + half))


def rejected(obs: DataFrame) -> DataFrame:
    """The rule by which an observation is refused, or null."""
    why = F.when(finite(F.col("value")).isNull(), "no finite value").when(F.col("error") <= 0, "error not positive")
    return obs.withColumn("rejected", why)


def nearest_cells(obs: DataFrame, lats: DataFrame, lons: DataFrame, wrap: bool = False) -> DataFrame:
    """Index of the nearest latitude and longitude of each observation, the first
    of equally near ones. The axes (idx, pos) are carried as one sorted array
    each: an axis is small by nature, and no observation meets all cells."""
    out = obs
    for name, axis, c in (("lat_idx", lats, "lat"), ("lon_idx", lons, "lon")):
        one = axis.agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("_axis"))
        out = out.crossJoin(F.broadcast(one))  # one row
        gap = lambda a: F.abs(a["pos"] - F.col(c))  # noqa: B023, E731
        far = (lambda a: F.least(gap(a), 360 - gap(a))) if wrap and c == "lon" else gap  # noqa: B023
        near = F.array_min(F.transform("_axis", lambda a: F.struct(far(a).alias("d"), a["idx"].alias("i"))))  # noqa: B023
        out = out.withColumn(name, near["i"]).drop("_axis")
    return out


def within(points: DataFrame, cells: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of points (p_lat, p_lon) and cells (lat, lon) within the radius,
    with their ``distance``. Both are dealt to latitude bands as wide as the
    radius, and in each band to stretches of longitude no narrower than the radius
    is there (near the poles the whole circle); a point goes to its own stretch
    and its neighbours, so pairs grow with the cells near a point only."""
    band = radius_km / DEGREE_KM * 1.001
    furthest = lambda k: F.greatest(F.abs((k - 1) * band), F.abs((k + 2) * band))  # noqa: E731  latitude that a point of this or the next band can have
    slant = lambda k: F.cos(F.radians(F.least(furthest(k), F.lit(90.0))))
    wide = 1.5 * math.sin(math.radians(min(band, 90.0)))
    stretches = lambda k: F.when(slant(k) > wide, F.greatest(F.floor(360 * slant(k) / (band * 1.1)), F.lit(1))).otherwise(1).cast("long")
    at = F.floor(F.col("p_lat") / band)
    own = lambda lon, k: F.floor(F.pmod(lon, F.lit(360.0)) / 360 * stretches(k))
    p = points.withColumn("_band", F.explode(F.array(at - 1, at, at + 1)))
    near = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.pmod(own(F.col("p_lon"), F.col("_band")) + i, stretches(F.col("_band"))))
    p = p.withColumn("_part", F.explode(F.array_distinct(near)))
    c = cells.withColumn("_band", F.floor(F.col("lat") / band))
    c = c.withColumn("_part", F.least(own(F.col("lon"), F.col("_band")), stretches(F.col("_band")) - 1))
    d = haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return p.join(c, ["_band", "_part"]).withColumn("distance", d).where(F.col("distance") <= radius_km).drop("_band", "_part")


def three_d_var(background: DataFrame, innovations: DataFrame, cell: list[str], radius_km: float, background_error: float, kind: str = "gaspari_cohn") -> DataFrame:
    """Increments of successive corrections: of each cell the taper-weighted mean
    of gain times innovation over the observations (p_lat, p_lon, innovation,
    error) within twice the radius. The pairs are summed for each cell."""
    pairs = within(innovations, background, 2 * radius_km)
    rho = taper(kind, F.col("distance") / radius_km)
    gain = background_error**2 / (background_error**2 + F.col("error") * F.col("error"))
    pairs = pairs.withColumns({"_rho": rho, "_x": gain * F.col("innovation") * rho}).where("_rho > 0")
    out = pairs.groupBy(*cell).agg(F.sum("_x").alias("x"), F.sum("_rho").alias("weight"), F.count(F.lit(1)).alias("n_obs"))
    return out.select(*cell, (F.col("x") / F.col("weight")).alias("increment"), "weight", "n_obs")


def initial_ensemble(background: DataFrame, members: int, keys: list[str], seed: int = 0, by: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """Members of noise of a hundredth of the field's deviation around the background."""
    std = background.groupBy(*by).agg(F.stddev_pop("value").alias("_s"))
    out = background.join(std, by).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    scale = F.when(F.col("_s") > 0, 0.01 * F.col("_s")).otherwise(0.001)
    return out.withColumn("value", F.col("value") + scale * hash_normal(seed, F.col("member"), *map(F.col, keys))).drop("_s")


def inflate(members: DataFrame, cell: list[str], factor: float, method: str = "multiplicative", seed: int = 0) -> DataFrame:
    w = W.partitionBy(*cell)
    mean = F.avg("value").over(w)
    if method in ("multiplicative", "relaxation"):
        return members.withColumn("value", mean + factor * (F.col("value") - mean))
    if method == "additive":
        noise = 0.01 * F.stddev_pop("value").over(w) * hash_normal(seed, F.col("member"), *map(F.col, cell))
        return members.withColumn("value", F.col("value") + noise)
    return members


def enkf(members: DataFrame, obs: DataFrame, group: str, radius_km: float, inflation: float = 1.0, seed: int = 0, kind: str = "gaspari_cohn", tile_km: float | None = None) -> DataFrame:
    """Mean and spread of each cell after the stochastic ensemble Kalman filter
    (``enkf.filtered``): members (group, member, lat, lon, value), observations
    (group, obs_id, p_lat, p_lon, value, error)."""
    return filtered(members, obs, group, radius_km, inflation, seed, kind, tile_km).drop("e")


def increments(analysis: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """Analysis less background of the cells (keys..., value) that both have."""
    before = background.select(*keys, F.col("value").alias("_b"))
    return analysis.join(before, keys).select(*keys, (F.col("value") - F.col("_b")).alias("increment"))


def nearest_levels(obs: DataFrame, levels: DataFrame, altitude: str = "altitude") -> DataFrame:
    """lev_idx of the level (idx, pos) nearest to each observation's altitude, the
    first of equally near ones; the lowest index without an altitude."""
    one = levels.agg(F.sort_array(F.collect_list(F.struct("idx", "pos"))).alias("_axis"))
    out = obs.crossJoin(F.broadcast(one))  # one row: an axis is small by nature
    near = F.array_min(F.transform("_axis", lambda a: F.struct(F.coalesce(F.abs(a["pos"] - F.col(altitude)), F.lit(0.0)).alias("d"), a["idx"].alias("i"))))
    return out.withColumn("lev_idx", near["i"]).drop("_axis")


def four_d_var(background: DataFrame, innovations: DataFrame, cell: list[str], centre: Column, width_hours: float, radius_km: float, background_error: float, ts: str = "ts", kind: str = "gaspari_cohn") -> DataFrame:
    """The increments of ``three_d_var`` from the observations in the window."""
    return three_d_var(background, in_window(innovations, centre, width_hours, ts), cell, radius_km, background_error, kind)


#: Which of the three procedures a method's name asks for.
METHODS = {"enkf": "enkf", "letkf": "enkf", "etkf": "enkf", "3dvar": "three_d_var", "4dvar": "four_d_var", "hybrid": "four_d_var"}


def procedure_of(method: Column) -> Column:
    """The procedure that a method's name means; an unknown one means the ensemble filter."""
    known = F.create_map(*(F.lit(x) for pair in METHODS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(method)), F.lit("enkf"))


def assimilate(method: str, background: DataFrame, obs: DataFrame, cell: list[str], centre: Column, radius_km: float = 500.0, background_error: float = 1.0, window_hours: float = 6.0, members: DataFrame | None = None, ensemble: int = 20, inflation: float = 1.0, seed: int = 0, tile_km: float | None = None, kind: str = "gaspari_cohn") -> DataFrame:
    """Increments and analysis (cell..., increment, analysis) by the method, of a
    background (cell..., lat, lon, value) and observations (obs_id, p_lat, p_lon, ts,
    value, innovation, error). Refused observations and, for 4DVar, those outside the
    window go first. A cell that no observation reaches keeps its value.

    The ensemble methods take ``members`` (member, lat, lon, value) of the background,
    or make ``ensemble`` of them around it; their increment is the mean after the
    filter less the mean before.
    """
    procedure = METHODS.get(method.lower(), "enkf")
    good = rejected(obs).where("rejected IS NULL").drop("rejected")
    if procedure == "enkf":
        if members is None:
            members = initial_ensemble(background.withColumn("_all", F.lit(1)), ensemble, cell, seed, ["_all"])
        members = members.select("member", "lat", "lon", "value").withColumn("group", F.lit(1))
        before = members.groupBy("lat", "lon").agg(F.avg("value").alias("_before"))
        after = enkf(members, good.withColumn("group", F.lit(1)), "group", radius_km, inflation, seed, kind, tile_km).select("lat", "lon", F.col("mean").alias("_after"))
        at = background.select(*cell, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "value")
        found = at.join(before, ["lat", "lon"]).join(after, ["lat", "lon"]).select(*cell, (F.col("_after") - F.col("_before")).alias("increment"))
    elif procedure == "four_d_var":
        found = four_d_var(background, good, cell, centre, window_hours, radius_km, background_error, kind=kind)
    else:
        found = three_d_var(background, good, cell, radius_km, background_error, kind)
    out = background.select(*cell, "value").join(found.select(*cell, "increment"), cell, "left").withColumn("increment", F.coalesce("increment", F.lit(0.0)))
    return out.select(*cell, "increment", (F.col("value") + F.col("increment")).alias("analysis"))
