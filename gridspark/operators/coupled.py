"""Model components on grids: initial fields, steps, coupling, ensembles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import clip, coriolis, finite, hash_normal


def axes(spark: SparkSession, resolution: float, lat: tuple[float, float] = (-90.0, 90.0), levels: list[float] = [0.0]) -> DataFrame:  # noqa: B006
    """Grid cells: lat_idx, lon_idx, lev_idx and their coordinates, from one range."""
    n_lat, n_lon, n_lev = int(round((lat[1] - lat[0]) / resolution)) + 1, int(round(360 / resolution)), len(levels)
    i = F.expr(f"cast(id div {n_lon * n_lev} AS INT)")
    j = F.expr(f"cast(id div {n_lev} % {n_lon} AS INT)")
    k = F.expr(f"cast(id % {n_lev} AS INT)")
    out = spark.range(n_lat * n_lon * n_lev).select(i.alias("lat_idx"), j.alias("lon_idx"), k.alias("lev_idx"))
    level = F.element_at(F.array(*map(F.lit, levels)), F.col("lev_idx") + 1)
    return out.withColumns({"lat": lat[0] + F.col("lat_idx") * resolution, "lon": F.col("lon_idx") * resolution, "level": level})


def spaced(a: float, b: float, n: int, geometric: bool = False) -> list[float]:
    if n == 1:
        return [a]
    return [a * (b / a) ** (i / (n - 1)) if geometric else a + (b - a) * i / (n - 1) for i in range(n)]


def atmosphere(spark: SparkSession, resolution: float = 5.0, levels: int = 5, seed: int = 0) -> DataFrame:
    g = axes(spark, resolution, levels=spaced(1000.0, 100.0, levels))
    lat, lev = F.radians("lat"), F.col("level")
    away = lambda centre, width: F.exp(-F.pow(lev - centre, 2.0) / width)
    keys = [F.col(c) for c in ("lat_idx", "lon_idx", "lev_idx")]
    return g.withColumns(
        {
            "temperature": 288.15 - 6.5e-3 * lev - 20 * F.pow(F.sin(lat), 2.0),
            "u_wind": 40 * away(250, 1e4) * F.pow(F.cos(lat), 2.0),
            "v_wind": hash_normal(seed, *keys),
            "w_wind": 0.01 * hash_normal(seed + 1, *keys),
            "relative_humidity": clip(0.7 * away(500, 5e4) * (0.5 + 0.5 * F.cos(lat)), 0.01, 0.99),
            "specific_humidity": clip(0.02 * away(500, 3e4) * F.exp(-F.pow(F.abs("lat") / 60, 2.0)), 1e-4, 0.04),
            "geopotential": 9.81 * (1000 - lev) * 10,
            "surface_pressure": 101325 * F.exp(-0.00012 * (90 - F.abs("lat"))),
            "precipitation": 0.001 * F.exp(-F.pow(F.abs("lat") / 30, 2.0)),
        }
    )


def ocean(spark: SparkSession, resolution: float = 5.0, levels: int = 5, seed: int = 0) -> DataFrame:
    g = axes(spark, resolution, (-80.0, 80.0), spaced(5.0, 5000.0, levels, geometric=True))
    surface = 30 * F.cos(F.radians("lat")) - 2 + 273.15
    keys = [F.col(c) for c in ("lat_idx", "lon_idx", "lev_idx")]
    out = g.withColumns({"sea_surface_temperature": surface, "water_temperature": 275.15 + (surface - 275.15) * F.exp(-F.col("level") / 1000)})
    return out.withColumns({"salinity": 35 + 0.5 * F.cos(F.radians("lat")), "u_current": 0.1 * hash_normal(seed, *keys), "v_current": 0.1 * hash_normal(seed + 1, *keys)})


def land(spark: SparkSession, resolution: float = 5.0) -> DataFrame:
    g = axes(spark, resolution, levels=[0.1, 0.4, 1.0, 2.0])
    skin = 288 - 30 * F.abs(F.sin(F.radians("lat")))
    return g.withColumns({"skin_temperature": skin, "soil_temperature": skin - 2 * F.col("level"), "soil_moisture": F.lit(0.3), "evapotranspiration": F.lit(0.002)})


def sea_ice(spark: SparkSession, resolution: float = 5.0) -> DataFrame:
    g = axes(spark, resolution)
    polar = F.abs(F.col("lat")) > 60
    cover = F.when(polar, clip((F.abs("lat") - 60) / 30, 0.0, 1.0)).otherwise(0.0)
    return g.withColumns({"sea_ice_concentration": cover, "sea_ice_thickness": 2 * cover, "sea_ice_temperature": F.lit(263.15)})


def step_atmosphere(state: DataFrame, seconds: float, step: int, seed: int = 0) -> DataFrame:
    hours = seconds / 3600
    keys = [F.col(c) for c in ("lat_idx", "lon_idx", "lev_idx")]
    noise = lambda s, size: size * hash_normal(seed * 1000 + step * 10 + s, *keys)
    f, u, v = coriolis(F.col("lat")), F.col("u_wind"), F.col("v_wind")
    return state.withColumns(
        {
            "temperature": F.col("temperature") - 0.0098 * F.col("w_wind") * seconds + noise(1, 0.1),
            "u_wind": u + f * v * hours + noise(2, 0.1),
            "v_wind": v - f * u * hours + noise(3, 0.1),
            "relative_humidity": clip(F.col("relative_humidity") + noise(4, 0.01), 0.01, 0.99),
        }
    )


def step_ocean(state: DataFrame, seconds: float) -> DataFrame:
    """Temperature by the gradient over the depth index."""
    from .quality import difference

    slope = difference(["lat_idx", "lon_idx"], "lev_idx", F.col("water_temperature"))
    return state.withColumn("water_temperature", F.col("water_temperature") - 1e-4 * slope * seconds / 3600)


def step_land(state: DataFrame, seconds: float, at_seconds: float, levels: int = 4) -> DataFrame:
    cycle = 5 * math.sin(2 * math.pi * (at_seconds % 86400) / 86400)
    dry = F.col("evapotranspiration") * seconds / 86400 / levels
    return state.withColumns({"skin_temperature": F.col("skin_temperature") + cycle * seconds / 86400, "soil_moisture": clip(F.col("soil_moisture") - dry, 0.0, 1.0)})


def step_sea_ice(state: DataFrame, seconds: float, at_seconds: float) -> DataFrame:
    season = 0.1 * math.sin(2 * math.pi * at_seconds / 86400 / 365.25) * seconds / 86400
    grown = F.col("sea_ice_concentration") + F.when(F.abs(F.col("lat")) > 60, season).otherwise(0.0)
    return state.withColumn("sea_ice_concentration", clip(grown, 0.0, 1.0))


@dataclass(frozen=True)
class Coupling:
    """A variable handed from one component to another every ``interval`` seconds."""

    source: str
    target: str
    source_var: str
    target_var: str
    method: str = "direct"  # or relaxation, flux
    scale: float = 1.0
    tau: float = 86400.0
    interval: float = 3600.0
    level: float | None = None  # of the source, the nearest
    target_level: float | None = None  # of the target, the nearest; else its first three


# What the components hand to each other when fully coupled, 20 maps over 8 interfaces.
COUPLINGS = (
    Coupling("atmosphere", "ocean", "temperature", "sea_surface_temperature", "relaxation", tau=3 * 86400, level=1000.0),
    Coupling("atmosphere", "ocean", "u_wind", "u_current", "flux", scale=0.001),
    Coupling("atmosphere", "ocean", "v_wind", "v_current", "flux", scale=0.001),
    Coupling("atmosphere", "ocean", "sensible_heat_flux", "water_temperature", "flux", scale=1 / (1025 * 4186 * 50)),
    Coupling("atmosphere", "ocean", "precipitation", "salinity", "flux", scale=-0.01),
    Coupling("ocean", "atmosphere", "sea_surface_temperature", "temperature", "relaxation", tau=86400, target_level=1000.0),
    Coupling("atmosphere", "land", "temperature", "skin_temperature", "relaxation", tau=86400, level=1000.0),
    Coupling("atmosphere", "land", "precipitation", "soil_moisture", "flux", scale=0.001),
    Coupling("atmosphere", "land", "shortwave_radiation", "skin_temperature", "flux", scale=1e-6),
    Coupling("land", "atmosphere", "skin_temperature", "temperature", "relaxation", tau=2 * 86400, target_level=1000.0),
    Coupling("land", "atmosphere", "evapotranspiration", "specific_humidity", "flux", scale=0.001),
    Coupling("land", "atmosphere", "albedo", "shortwave_radiation", "direct", scale=0.5),
    Coupling("ocean", "sea_ice", "water_temperature", "sea_ice_temperature", "relaxation", tau=5 * 86400, level=5.0),
    Coupling("ocean", "sea_ice", "u_current", "ice_u_velocity", "direct", scale=0.01, level=5.0),
    Coupling("ocean", "sea_ice", "v_current", "ice_v_velocity", "direct", scale=0.01, level=5.0),
    Coupling("sea_ice", "ocean", "sea_ice_concentration", "sea_surface_temperature", "flux", scale=-5e-6),
    Coupling("atmosphere", "sea_ice", "temperature", "sea_ice_temperature", "relaxation", tau=2 * 86400, level=1000.0),
    Coupling("atmosphere", "sea_ice", "u_wind", "ice_u_velocity", "flux", scale=0.0001),
    Coupling("atmosphere", "sea_ice", "v_wind", "ice_v_velocity", "flux", scale=0.0001),
    Coupling("sea_ice", "atmosphere", "sea_ice_concentration", "shortwave_radiation", "flux", scale=-0.01),
)
ONE_WAY = (
    Coupling("atmosphere", "ocean", "temperature", "sea_surface_temperature", "relaxation", tau=86400),
    Coupling("atmosphere", "land", "precipitation", "soil_moisture", "flux", scale=0.001),
)


def couplings_of(kind: str) -> tuple[Coupling, ...]:
    """The maps of a kind of coupling: both ways and full are the same, one way
    has two, anything else none."""
    return {"fully_coupled": COUPLINGS, "two_way": COUPLINGS, "one_way": ONE_WAY}.get(kind, ())


def coupling_table(spark: SparkSession, couplings=COUPLINGS) -> DataFrame:
    rows = [(c.source, c.target, c.source_var, c.target_var, c.method, float(c.scale), float(c.tau), c.level) for c in couplings]
    return spark.createDataFrame(rows, "source string, target string, source_var string, target_var string, method string, scale double, tau double, level double")


def nearest_level(state: DataFrame, level: float) -> DataFrame:
    """Rows of the level nearest to the wanted one, the first of equal ones."""
    own = state.select("lev_idx", "level").distinct()
    pick = own.agg(F.min_by("lev_idx", F.struct(F.abs(F.col("level") - level), F.col("lev_idx"))).alias("lev_idx"))
    return state.join(F.broadcast(pick), "lev_idx", "left_semi")


def couple(target: DataFrame, source: DataFrame, c: Coupling, seconds: float) -> DataFrame:
    """The target's field drawn to, replaced by or fed from the source's, on the
    same latitudes and longitudes; of a field with levels the first three, or the
    one named. A map of a variable that either side lacks changes nothing."""
    if c.source_var not in source.columns or c.target_var not in target.columns:
        return target
    picked = nearest_level(source, c.level) if c.level is not None else source.where("lev_idx = 0")
    given = picked.select("lat", "lon", F.col(c.source_var).alias("_given"))
    x, g = F.col(c.target_var), F.col("_given") * c.scale
    if c.method == "relaxation":
        new = x + min(1.0, seconds / c.tau) * (g - x)
    else:
        new = g if c.method == "direct" else x + g * seconds
    meant, columns = F.col("lev_idx") < 3, target.columns
    if c.target_level is not None:
        own = nearest_level(target, c.target_level).select("lev_idx").distinct().withColumn("_meant", F.lit(True))
        target, meant = target.join(F.broadcast(own), "lev_idx", "left"), F.coalesce("_meant", F.lit(False))  # one level
    out = target.join(given, ["lat", "lon"], "left").withColumn(c.target_var, F.when(meant & F.col("_given").isNotNull(), new).otherwise(x))
    return out.select(*columns)


def states(spark: SparkSession, steps: int, step_seconds: float = 10800.0, resolution: float = 10.0, couplings=COUPLINGS, seed: int = 0) -> Iterator[dict[str, DataFrame]]:
    """The state at the start and after each of ``steps`` steps, all components
    stepped and coupled in their order; every step is written to the shared folder, so
    lineage does not grow and a lost executor costs a step."""
    from ..plans.scratch import materialise

    state = {"atmosphere": atmosphere(spark, resolution, seed=seed), "ocean": ocean(spark, resolution, seed=seed), "land": land(spark, resolution), "sea_ice": sea_ice(spark, resolution)}
    yield state
    last = dict.fromkeys(couplings, float("-inf"))
    for k in range(steps):
        at = (k + 1) * step_seconds
        state["atmosphere"] = step_atmosphere(state["atmosphere"], step_seconds, k, seed)
        state["ocean"] = step_ocean(state["ocean"], step_seconds)
        state["land"] = step_land(state["land"], step_seconds, at)
        state["sea_ice"] = step_sea_ice(state["sea_ice"], step_seconds, at)
        for c in couplings:
            if at - last[c] >= c.interval:
                state[c.target] = couple(state[c.target], state[c.source], c, step_seconds)
                last[c] = at
        state = {n: materialise(df, f"state-{n}") for n, df in state.items()}
        yield state


def run(spark: SparkSession, hours: float, step_seconds: float = 10800.0, resolution: float = 10.0, couplings=COUPLINGS, seed: int = 0) -> dict[str, DataFrame]:
    """The state after ``hours``."""
    for state in states(spark, int(hours * 3600 / step_seconds), step_seconds, resolution, couplings, seed):
        pass
    return state


def outputs(spark: SparkSession, hours: float, every: float, step_seconds: float = 10800.0, resolution: float = 10.0, couplings=COUPLINGS, seed: int = 0, most: int = 50) -> DataFrame:
    """Means of the surface fields after each ``every`` hours, ``most`` times at
    most: hours, field, mean. The model runs once, and each output reads the state
    of its step."""
    found, times = None, [every * (k + 1) for k in range(min(most, int(hours // every)))]
    after = [int(at * 3600 / step_seconds) for at in times]
    for k, state in enumerate(states(spark, max(after, default=0), step_seconds, resolution, couplings, seed)):
        for at in (t for t, n in zip(times, after) if n == k):
            top = combined(state)
            names = [c for c in top.columns if c not in ("lat", "lon")]
            one = top.agg(*(F.avg(c).alias(c) for c in names)).unpivot([], names, "field", "mean").withColumn("hours", F.lit(at))
            found = one if found is None else found.unionByName(one)
    return found


def combined(state: dict[str, DataFrame]) -> DataFrame:
    """Surface fields of all components side by side, named component_variable,
    on the first component's latitudes and longitudes."""
    out = None
    for name, df in state.items():
        own = [c for c in df.columns if c not in ("lat", "lon", "level", "lat_idx", "lon_idx", "lev_idx")]
        top = df.where("lev_idx = 0").select("lat", "lon", *(F.col(c).alias(f"{name}_{c}") for c in own))
        out = top if out is None else out.join(top, ["lat", "lon"], "left")
    return out


def perturbed(control: DataFrame, members: int, keys: list[str], method: str = "random", amplitude: float = 0.05, seed: int = 42, by: list[str] = ["variable"], noise=hash_normal) -> DataFrame:  # noqa: B006
    """Members of a control (keys..., variable, value): ``random`` noise in the
    field's own deviations, or ``bred`` vectors of one norm over all variables. The
    norm of a member is one row, summed up before the shuffle."""
    out = control.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    z = noise(seed, F.col("member"), *map(F.col, keys), *map(F.col, by))
    if method == "bred":
        out = out.withColumn("_z", z)
        norms = out.groupBy("member").agg(F.sqrt(F.avg(F.col("_z") * F.col("_z"))).alias("_norm"))
        return out.join(F.broadcast(norms), "member").select(*control.columns, "member", "_z", "_norm").withColumn("value", F.col("value") + amplitude * F.col("_z") / F.col("_norm")).drop("_z", "_norm")  # a row for each member
    std = control.groupBy(*by).agg(F.stddev_pop(finite(F.col("value"))).alias("_s"))
    return out.join(std, by).withColumn("value", F.col("value") + amplitude * F.col("_s") * z).drop("_s")


def lagged(states: DataFrame, cell: list[str], members: int, lags=(0, 6, 12, 18, 24)) -> DataFrame:
    """Members that are the mean of the latest state and the one ``lag`` steps
    before (rows cell..., step, value); the latest where history is too short."""
    w = W.partitionBy(*cell).orderBy("step")
    parts = []
    for m in range(members):
        before = F.lag("value", lags[m % len(lags)]).over(w) if lags[m % len(lags)] else F.col("value")
        parts.append(states.withColumns({"member": F.lit(m), "_v": (F.col("value") + F.coalesce(before, F.col("value"))) / 2, "_last": F.lead("step").over(w).isNull()}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("_last").select(*cell, "member", F.col("_v").alias("value"))


def smoothed_noise(grid: DataFrame, by: list[str], sigma: float, seed: int = 200, noise=hash_normal) -> DataFrame:
    """Gaussian-smoothed noise on each group's grid (lat_idx, lon_idx from 0), cut at
    four ``sigma``, edges reflected; every group has noise of its own. A cell's noise
    is a function of its key, so each works out its neighbourhood's for itself: no
    grid is one task and no cell is moved but for the grids' sizes."""
    r = max(1, int(4 * sigma + 0.5))
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    kernel = F.array(*(F.lit(w / sum(weights)) for w in weights))
    sizes = grid.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg((F.max("lat_idx") + 1).alias("_n"), (F.max("lon_idx") + 1).alias("_m"))
    out = grid.join(sizes, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]) if by else grid.crossJoin(F.broadcast(sizes))  # one row
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]

    def inside(i: Column, n: Column) -> Column:
        at = F.pmod(i, 2 * n)
        return F.when(at < n, at).otherwise(2 * n - 1 - at).cast("long")

    def along(value) -> Column:
        return F.aggregate(F.sequence(F.lit(-r), F.lit(r)), F.lit(0.0), lambda s, o: s + F.element_at(kernel, o + r + 1) * value(o))

    z = along(lambda a: along(lambda b: noise(seed, *keys, inside(F.col("lat_idx") + a, F.col("_n")), inside(F.col("lon_idx") + b, F.col("_m")))))
    return out.select(*(F.col(c) for c in grid.columns), z.alias("noise"))


def stochastic(control: DataFrame, members: int, by: list[str] = ["variable"], sigma: float = 2.0, amplitude: float = 0.05, seed: int = 200, noise=hash_normal) -> DataFrame:  # noqa: B006
    """Members of a control (by..., lat_idx, lon_idx, value) that differ by smooth
    noise in the field's own deviations."""
    std = control.groupBy(*by).agg(F.stddev_pop(finite(F.col("value"))).alias("_s"))
    out = control.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    out = smoothed_noise(out, [*by, "member"], sigma, seed, noise).join(std, by)
    return out.withColumn("value", F.col("value") + amplitude * F.col("_s") * F.col("noise")).drop("noise", "_s")


def generated(control: DataFrame, members: int, keys: list[str], method: str = "random", history: DataFrame | None = None, **options) -> DataFrame:
    """Initial members by the method's name: ``bred``, ``stochastic``, ``lagged``
    (which needs the history), else random noise, as for the methods that have no
    procedure of their own."""
    if method == "stochastic":
        return stochastic(control, members, **options)
    if method == "lagged" and history is not None:
        return lagged(history, keys, members, **options)
    return perturbed(control, members, keys, "bred" if method in ("bred", "bred_vectors") else "random", **options)


def integrate(members: DataFrame, key: str, step, lead_seconds: float, dt: float) -> DataFrame:
    """Each member (a group) moved on by ``step(pandas, seconds)`` until the lead time."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = 0.0
        while at < lead_seconds:
            pdf = step(pdf, min(dt, lead_seconds - at))
            at += dt
        return pdf

    return members.groupBy(key).applyInPandas(one, members.schema)


def angle(u: Column, v: Column) -> Column:
    return F.degrees(F.atan2(v, u))
